"""Canonical flow schema and the fixed lookup values the operators rely on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Canonical feature names, in model order.
# --------------------------------------------------------------------------
FEATURES = (
    "Dst Port", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts",
    "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
    "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
    "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)

# The 24 features a scenario vector is made of.
SCENARIO_FEATURES = (
    "Flow Duration",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Down/Up Ratio", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)

# Long-name dialect -> canonical names.
LONG_NAME_ALIASES = {
    "total fwd packets": "Tot Fwd Pkts",
    "total backward packets": "Tot Bwd Pkts",
    "fwd packets length total": "TotLen Fwd Pkts",
    "bwd packets length total": "TotLen Bwd Pkts",
    "fwd packet length max": "Fwd Pkt Len Max",
    "fwd packet length min": "Fwd Pkt Len Min",
    "fwd packet length mean": "Fwd Pkt Len Mean",
    "fwd packet length std": "Fwd Pkt Len Std",
    "bwd packet length max": "Bwd Pkt Len Max",
    "bwd packet length min": "Bwd Pkt Len Min",
    "bwd packet length mean": "Bwd Pkt Len Mean",
    "bwd packet length std": "Bwd Pkt Len Std",
    "flow bytes/s": "Flow Byts/s",
    "flow packets/s": "Flow Pkts/s",
    "fwd iat total": "Fwd IAT Tot",
    "bwd iat total": "Bwd IAT Tot",
    "fwd header length": "Fwd Header Len",
    "bwd header length": "Bwd Header Len",
    "fwd packets/s": "Fwd Pkts/s",
    "bwd packets/s": "Bwd Pkts/s",
    "packet length min": "Pkt Len Min",
    "packet length max": "Pkt Len Max",
    "packet length mean": "Pkt Len Mean",
    "packet length std": "Pkt Len Std",
    "packet length variance": "Pkt Len Var",
    "fin flag count": "FIN Flag Cnt",
    "syn flag count": "SYN Flag Cnt",
    "rst flag count": "RST Flag Cnt",
    "psh flag count": "PSH Flag Cnt",
    "ack flag count": "ACK Flag Cnt",
    "avg packet size": "Pkt Size Avg",
    "avg fwd segment size": "Fwd Seg Size Avg",
    "avg bwd segment size": "Bwd Seg Size Avg",
    "init fwd win bytes": "Init Fwd Win Byts",
    "init bwd win bytes": "Init Bwd Win Byts",
    "fwd act data packets": "Fwd Act Data Pkts",
    "destination port": "Dst Port",
    "subflow fwd packets": "Subflow Fwd Pkts",
    "subflow fwd bytes": "Subflow Fwd Byts",
    "subflow bwd packets": "Subflow Bwd Pkts",
    "subflow bwd bytes": "Subflow Bwd Byts",
}

# snake_case dialect -> canonical names.
SNAKE_CASE_ALIASES = {
    "dst_port": "Dst Port",
    "duration": "Flow Duration",
    "fwd_packets_count": "Tot Fwd Pkts",
    "bwd_packets_count": "Tot Bwd Pkts",
    "fwd_total_payload_bytes": "TotLen Fwd Pkts",
    "bwd_total_payload_bytes": "TotLen Bwd Pkts",
    "fwd_payload_bytes_max": "Fwd Pkt Len Max",
    "fwd_payload_bytes_min": "Fwd Pkt Len Min",
    "fwd_payload_bytes_mean": "Fwd Pkt Len Mean",
    "fwd_payload_bytes_std": "Fwd Pkt Len Std",
    "bwd_payload_bytes_max": "Bwd Pkt Len Max",
    "bwd_payload_bytes_min": "Bwd Pkt Len Min",
    "bwd_payload_bytes_mean": "Bwd Pkt Len Mean",
    "bwd_payload_bytes_std": "Bwd Pkt Len Std",
    "bytes_rate": "Flow Byts/s",
    "packets_rate": "Flow Pkts/s",
    "packets_iat_mean": "Flow IAT Mean",
    "packet_iat_std": "Flow IAT Std",
    "packet_iat_max": "Flow IAT Max",
    "packet_iat_min": "Flow IAT Min",
    "fwd_packets_iat_total": "Fwd IAT Tot",
    "fwd_packets_iat_mean": "Fwd IAT Mean",
    "fwd_packets_iat_std": "Fwd IAT Std",
    "fwd_packets_iat_max": "Fwd IAT Max",
    "fwd_packets_iat_min": "Fwd IAT Min",
    "bwd_packets_iat_total": "Bwd IAT Tot",
    "bwd_packets_iat_mean": "Bwd IAT Mean",
    "bwd_packets_iat_std": "Bwd IAT Std",
    "bwd_packets_iat_max": "Bwd IAT Max",
    "bwd_packets_iat_min": "Bwd IAT Min",
    "fwd_psh_flag_counts": "Fwd PSH Flags",
    "fwd_total_header_bytes": "Fwd Header Len",
    "bwd_total_header_bytes": "Bwd Header Len",
    "fwd_packets_rate": "Fwd Pkts/s",
    "bwd_packets_rate": "Bwd Pkts/s",
    "payload_bytes_min": "Pkt Len Min",
    "payload_bytes_max": "Pkt Len Max",
    "payload_bytes_mean": "Pkt Len Mean",
    "payload_bytes_std": "Pkt Len Std",
    "payload_bytes_variance": "Pkt Len Var",
    "fin_flag_counts": "FIN Flag Cnt",
    "syn_flag_counts": "SYN Flag Cnt",
    "rst_flag_counts": "RST Flag Cnt",
    "psh_flag_counts": "PSH Flag Cnt",
    "ack_flag_counts": "ACK Flag Cnt",
    "down_up_rate": "Down/Up Ratio",
    "avg_segment_size": "Pkt Size Avg",
    "fwd_avg_segment_size": "Fwd Seg Size Avg",
    "bwd_avg_segment_size": "Bwd Seg Size Avg",
    "fwd_init_win_bytes": "Init Fwd Win Byts",
    "bwd_init_win_bytes": "Init Bwd Win Byts",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}

# Stand-in source columns for two features (opt-in, see clean.py).
FEATURE_FALLBACKS = {
    "Fwd Act Data Pkts": ("fwd_packets_count",),
    "Fwd Seg Size Min": ("fwd_payload_bytes_min",),
}

COLUMN_ALIASES = {**LONG_NAME_ALIASES, **SNAKE_CASE_ALIASES}

# --------------------------------------------------------------------------
# Service ports.
# --------------------------------------------------------------------------
WEB_PORTS = (80, 443, 3000, 5000, 8000, 8080, 8443, 8888)
AUTH_PORTS = (21, 22, 23, 1433, 3306, 3389, 5432, 5900, 6379, 27017)
PORT_CLASS_COUNT = 3  # 0 web, 1 auth/service, 2 other

# Display names of well-known ports in the traffic feed.
PORT_ENDPOINTS = {
    80: "/http/traffic",
    443: "/https/secure",
    22: "/ssh/auth",
    21: "/ftp/transfer",
    53: "/dns/query",
    3389: "/rdp/remote",
    445: "/smb/share",
    8080: "/proxy/alt",
}
FEED_POST_PORTS = (80, 443, 8080)
FEED_BASE_TIME = "2026-03-22 12:00:00"

# --------------------------------------------------------------------------
# Label vocabulary.
# --------------------------------------------------------------------------
LABEL_FAMILIES = {
    "dos_hulk": "DoS attacks-Hulk",
    "dos attacks-hulk": "DoS attacks-Hulk",
    "dos_slowhttptest": "DoS attacks-SlowHTTPTest",
    "dos attacks-slowhttptest": "DoS attacks-SlowHTTPTest",
    "dos_slowloris": "DoS attacks-Slowloris",
    "dos attacks-slowloris": "DoS attacks-Slowloris",
    "dos_goldeneye": "DoS attacks-GoldenEye",
    "dos attacks-goldeneye": "DoS attacks-GoldenEye",
    "port_scan": "PortScan",
    "web_brute_force": "Brute Force -Web",
    "web xss": "Brute Force -XSS",
    "web_xss": "Brute Force -XSS",
    "web_sql_injection": "SQL Injection",
    "web sql injection": "SQL Injection",
    "ddos_loit": "DDoS attacks-LOIC-HTTP",
    "ddos loit": "DDoS attacks-LOIC-HTTP",
    "botnet_ares": "Bot",
    "botnet ares": "Bot",
    "ftp-patator": "FTP-BruteForce",
    "ssh-patator": "SSH-Bruteforce",
}
PREFERRED_SOURCES = {
    "dos attacks-hulk": "dos_hulk.csv",
    "dos attacks-slowhttptest": "dos_slowhttptest.csv",
    "dos attacks-slowloris": "dos_slowloris.csv",
    "dos attacks-goldeneye": "dos_golden_eye.csv",
    "brute force -web": "web_brute_force.csv",
    "brute force -xss": "web_xss.csv",
    "sql injection": "web_sql_injection.csv",
    "ddos attacks-loic-http": "ddos_loit.csv",
    "bot": "botnet_ares.csv",
    "ftp-bruteforce": "ftp_patator.csv",
    "ssh-bruteforce": "ssh_patator-new.csv",
}
HARD_LABELS = ("PortScan", "SQL Injection")
ATTACK_KEYWORDS = {
    "all": (),
    "ddos": ("ddos", "ddo s"),
    "bruteforce": (
        "brute force", "bruteforce", "ftp-patator", "ssh-patator",
        "web brute force", "ftp patator", "ssh patator",
    ),
    "portscan": ("portscan", "port scan", "port-scan"),
    "dos": ("dos", "hulk", "goldeneye", "slowloris", "slowhttptest"),
    "botnet": ("bot", "botnet"),
    "infiltration": ("infiltration",),
    "web": ("web attack", "xss", "sql injection", "sql-injection"),
}

# Capture files whose high-rate flows go to the flood detector
# when streaming, and the larger set that detector is trained on.
FLOOD_STREAM_FILES = (
    "ddos1-tuesday-20-02-2018_trafficforml_cicflowmeter.parquet",
    "ddos2-wednesday-21-02-2018_trafficforml_cicflowmeter.parquet",
    "dos1-thursday-15-02-2018_trafficforml_cicflowmeter.parquet",
    "dos2-friday-16-02-2018_trafficforml_cicflowmeter.parquet",
    "ddos_loit.csv",
    "dos_golden_eye.csv",
    "dos_hulk.csv",
    "dos_slowhttptest.csv",
    "dos_slowloris.csv",
)
FLOOD_TRAINING_FILES = FLOOD_STREAM_FILES + (
    "friday_benign.csv",
    "monday_benign.csv",
    "thursday_benign.csv",
    "tuesday_benign.csv",
    "wednesday_benign.csv",
)
FLOOD_MIN_PACKET_RATE = 50.0

# --------------------------------------------------------------------------
# Triage constants.
# --------------------------------------------------------------------------
ACTIONS = ("Dismiss", "Monitor", "Escalate")
LOAD_PHASES = (0.1, 0.3, 0.5, 0.7, 0.9)
BATCH_ANALYST_LOAD = 0.3
THREAT_BUCKETS, LOAD_BUCKETS, DENSITY_BUCKETS = 20, 20, 5
DENSITY_ROWS = 100
UCB_WEIGHT = 1.0
LEARNING_RATE, LEARNING_DECAY = 0.15, 0.001
ESCALATE_BAND, MONITOR_BAND = 0.7, 0.3
REWARD_MISSED_THREAT = -3000.0
REWARD_ESCALATED_THREAT = 100.0
REWARD_MONITORED_THREAT = 50.0
REWARD_DISMISSED_BENIGN = 15.0
REWARD_ESCALATED_BENIGN = -120.0
REWARD_MONITORED_BENIGN = -75.0

# Behaviour score.
BEHAVIOUR_WINDOW_SECONDS = 60
BEHAVIOUR_MAX_FLOWS = 200
SHORT_FLOW_MICROS = 1_000.0
LARGE_PAYLOAD_BYTES = 10_000.0
RATE_SATURATION = 300.0
PORT_SATURATION = 20.0
DURATION_SATURATION = 120_000.0
BEHAVIOUR_COLUMNS = (
    "beh_conn_rate_per_min",
    "beh_short_flow_ratio",
    "beh_unique_dst_ports",
    "beh_pkt_size_std",
    "beh_flow_count_window",
    "beh_large_payload_ratio",
    "beh_avg_duration",
)

FLOW_SCHEMA = T.StructType(
    [T.StructField(name, T.FloatType()) for name in FEATURES]
    + [T.StructField("Label", T.StringType())]
)

POLICY_SCHEMA = T.StructType(
    [
        T.StructField("tb", T.IntegerType()),
        T.StructField("lb", T.IntegerType()),
        T.StructField("db", T.IntegerType()),
        T.StructField("pb", T.IntegerType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("q", T.DoubleType()),
        T.StructField("visits", T.LongType()),
    ]
)

SOC_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("host", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_num", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("is_internal_src", T.IntegerType()),
        T.StructField("is_internal_dst", T.IntegerType()),
        T.StructField("tags", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("label_suspicious", T.IntegerType()),
    ]
)

DECISION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("threat_score", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("analyst_load", T.DoubleType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("flow_dur", T.LongType()),
    ]
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("events_captured", T.LongType()),
        T.StructField("failed_requests", T.LongType()),
        T.StructField("active_threats", T.LongType()),
        T.StructField("flagged_ips", T.LongType()),
        T.StructField("logs", T.ArrayType(DECISION_SCHEMA)),
    ]
)
