"""Fixed values shared by every module.

Everything below is a fixed value: the log format, the label numbering and the
result column names have to be exactly these for results to be right.
"""

# Event-log class folders and their labels.
CLASS_LABELS = {
    "baseline": 0,
    "oom": 1,
    "skew": 2,
    "serialization": 3,
    "network": 4,
    "disk": 5,
    "metadata": 6,
}

# Display names by label.
LABEL_NAMES = {
    0: "Baseline",
    1: "OOM",
    2: "Data Skew",
    3: "Serialization Failure",
    4: "Network Timeout",
    5: "Disk Space Failure",
    6: "Metadata Failure",
}

# Class names as the report spells them.
REPORT_CLASS_NAMES = {
    0: "Baseline",
    1: "OOM",
    2: "Data Skew",
    3: "Serialization",
    4: "Network Timeout",
    5: "Disk Space",
    6: "Metadata",
}

# Event names in the log.
TASK_END = "SparkListenerTaskEnd"
APPLICATION_END = "SparkListenerApplicationEnd"
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
STAGE_COMPLETED = "SparkListenerStageCompleted"

# The 25 feature columns, in their published order.
FEATURES = [
    "mean_task_duration",
    "std_task_duration",
    "max_task_duration",
    "total_memory_spilled",
    "total_disk_spilled",
    "total_shuffle_read",
    "total_shuffle_write",
    "total_gc_time",
    "total_stages",
    "failed_stages",
    "max_stage_parallelism",
    "stage_depth_of_failure",
    "completed_stage_ratio",
    "failed_stage_ratio",
    "spill_per_stage",
    "gc_per_stage",
    "duration_heterogeneity_ratio",
    "duration_variance",
    "max_min_duration_ratio",
    "spill_ratio",
    "disk_spill_ratio",
    "peak_memory_ratio",
    "gc_time_ratio",
    "task_failure_rate",
    "retry_count",
]

# Ablation: features dropped by each model, cumulative from A to D.
DROPPED_BY_MODEL = {
    "A": [],
    "B": ["total_stages", "stage_depth_of_failure"],
    "C": ["total_stages", "stage_depth_of_failure", "peak_memory_ratio"],
    "D": [
        "total_stages",
        "stage_depth_of_failure",
        "peak_memory_ratio",
        "total_disk_spilled",
        "disk_spill_ratio",
        "retry_count",
        "failed_stage_ratio",
    ],
}

# Features whose within-class spread is examined for confounding.
CONFOUND_CANDIDATES = [
    "total_stages",
    "stage_depth_of_failure",
    "peak_memory_ratio",
    "duration_heterogeneity_ratio",
]

# Run-manifest columns and the statuses that count as completed.
MANIFEST_COLUMNS = [
    "AppName",
    "FailureType",
    "Label",
    "RunId",
    "Timestamp",
    "AppId",
    "Status",
]
COMPLETED_STATUSES = ["FINISHED", "FAILED"]

# Confidence weights of a root-cause result.
CONFIDENCE_BASE = 0.5
CONFIDENCE_CLEAR_REASON = 0.2
CONFIDENCE_SINGLE_PARENT = 0.15
CONFIDENCE_CLEAN_PARENTS = 0.15
CONFIDENCE_EXTRA_ROOT = 0.1

# Sentences of the result tables.
NO_FAILURE_NAME = "None"
NO_FAILURE_REASON = "NO_FAILURE"
UNKNOWN = "Unknown"
NOT_AVAILABLE = "Not Available"
REPORT_NOTE = (
    "root_cause_analysis and failure_classification are independent analyses "
    "over the same raw event log; classification does not currently use "
    "root_cause_analysis as an input."
)
