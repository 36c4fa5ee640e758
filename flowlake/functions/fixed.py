"""Names, texts and numbers that outputs must reproduce exactly."""

from __future__ import annotations

# --- scenario key -> description, in report order -----------------------------------------
SCENARIO_TEXT = {
    "nmap_syn_scan": "Nmap SYN stealth port scan across all 65,535 ports",
    "nmap_service_scan": "Nmap service and OS detection scan (-sV -sC -O)",
    "nmap_evasion_scan":
        "Nmap IDS/firewall evasion scan (fragmentation, decoys, TTL manipulation, badsum)",
    "hydra_ssh_brute": "Hydra SSH credential brute force attack",
    "hydra_http_brute": "Hydra HTTP form brute force against DVWA and phpMyAdmin",
    "c2_beacon": "Simulated C2 beaconing (regular, jittered, and exfiltration modes)",
    "slowhttptest_dos": "Slowloris slow HTTP denial of service attack",
    "metasploit_ms17010": "Metasploit EternalBlue MS17-010 SMB exploit attempt",
}

# --- features shown in an alert text, in order ----------------------------------------------
KEY_FEATURES = (
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "flow_byts_s", "flow_pkts_s",
    "fwd_pkt_len_mean", "bwd_pkt_len_mean", "syn_flag_cnt", "rst_flag_cnt", "ack_flag_cnt",
    "psh_flag_cnt", "fwd_iat_mean", "bwd_iat_mean", "init_fwd_win_byts",
    "init_bwd_win_byts", "down_up_ratio", "fwd_pkts_s", "bwd_pkts_s",
)

# --- definitions as printed in the prompt: (features, label, definition) --------------------
FEATURE_DEFINITIONS = (
    (("flow_duration",), "flow_duration", "total flow duration in microseconds"),
    (("tot_fwd_pkts", "tot_bwd_pkts"), "tot_fwd_pkts / tot_bwd_pkts",
     "total packets sent forward and backward"),
    (("flow_byts_s", "flow_pkts_s"), "flow_byts_s / flow_pkts_s",
     "bytes and packets per second"),
    (("fwd_pkt_len_mean", "bwd_pkt_len_mean"), "fwd/bwd_pkt_len_mean",
     "average packet size each direction"),
    (("syn_flag_cnt", "rst_flag_cnt", "ack_flag_cnt", "psh_flag_cnt"),
     "syn/rst/ack/psh_flag_cnt", "TCP flag counts across the flow"),
    (("fwd_iat_mean", "bwd_iat_mean"), "fwd/bwd_iat_mean",
     "mean time between packets (microseconds)"),
    (("init_fwd_win_byts", "init_bwd_win_byts"), "init_fwd/bwd_win_byts",
     "initial TCP window size"),
    (("down_up_ratio",), "down_up_ratio", "ratio of download to upload bytes"),
)

NO_FEATURES_TEXT = "  (no significant feature values)"

# --- prompt: {s} description, {n} flow number, {p} confidence, {f} features, {k} scenario key
PROMPT_OPENING = (
    "You are a cybersecurity analyst reviewing network traffic flagged as malicious"
    " by an ML classifier.\n\n"
    "ATTACK CONTEXT: This flow was generated during a \"")
PROMPT_AFTER_SCENARIO = "\" attack.\n\nFlow #"
PROMPT_AFTER_NUMBER = " was classified as MALICIOUS with "
PROMPT_AFTER_CONFIDENCE = " confidence.\n\nKey network flow features:\n"
PROMPT_BEFORE_DEFINITIONS = "\n\nFeature definitions:\n"
PROMPT_QUESTIONS = (
    "\n\nIn 3-4 sentences explain:\n"
    "1. What specific attack behavior these features reveal for a \"")
PROMPT_CLOSING = (
    "\" attack\n"
    "2. Which features are most suspicious and exactly why\n"
    "3. How this attack differs from normal benign traffic\n\n"
    "Be specific, technical, and reference the actual feature values.")

# --- columns and codes ------------------------------------------------------------------------
NON_FEATURES = ("src_ip", "dst_ip", "timestamp", "scenario", "label")
PLACEHOLDER_SCENARIO = "EXAMPLE_DO_NOT_USE"
SESSION_LABELS = ("malicious", "benign")
IDS_EVENT_TYPES = ("alert", "flow", "dns", "http")
CREDENTIAL_MARK = "login:"
METRIC_ORDER = ("accuracy", "precision", "recall", "f1", "roc_auc")
TCP_FLAGS = {"syn": 2, "rst": 4, "psh": 8, "ack": 16}

# --- defaults -----------------------------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.2
UNDERSAMPLE_RATIO = 3
LOCAL_TO_UTC_HOURS = 6
MIN_CAPTURE_KB = 100
FLOWS_PER_SCENARIO = 2
TOP_FEATURES = 20
PREVIEW_CHARS = 120
