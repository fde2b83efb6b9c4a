"""Column models and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: labels, roles, container names -------------------------------
APP_LABEL = "spark-app-selector"
ID_LABEL = "spark-exec-id"
PROFILE_LABEL = "spark-exec-resourceprofile-id"
ROLE_LABEL = "spark-role"
INACTIVE_LABEL = "spark-exec-inactive"
DRIVER_ROLE = "driver"
EXECUTOR_ROLE = "executor"
EXECUTOR_CONTAINER = "spark-kubernetes-executor"
DRIVER_CONTAINER = "spark-kubernetes-driver"

# --- fixed values: timing and sizing defaults -----------------------------------
BATCH_SIZE = 5
BATCH_DELAY_MS = 1_000
CREATION_TIMEOUT_MS = 600_000
IDLE_TIMEOUT_MS = 60_000
MISSING_DELTA_MS = 30_000
REMOVAL_TTL_MS = 180_000
KILL_GRACE_MS = 5_000
BUNDLE_BUDGET = 1_572_864
REGISTERED_RATIO = 0.8
UNKNOWN_EXIT_CODE = -1

# --- fixed values: names of settings, and the texts that carry them ---------------
MISSING_DELTA_KEY = "spark.kubernetes.executor.missingPodDetectDelta"
PROPERTIES_FILE = "spark.properties"
PROPERTIES_HEADER = "#Java properties built from Kubernetes config map with name: "
MISSING_TEXT = (
    "The executor with ID %d (registered at %d ms) was not found in the cluster at the "
    "polling time (%d ms) which is after the accepted detect delta time (%d ms) configured "
    "by `" + MISSING_DELTA_KEY + "`. The executor may have been deleted but the driver "
    "missed the deletion event. Marking this executor as failed."
)

# --- fixed values: states; the position is the state's integer code --------------
STATES = ["pending", "running", "succeeded", "failed", "terminating", "deleted", "unknown"]
FINAL_STATES = ["succeeded", "failed", "deleted", "terminating"]

CONTAINER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("running", T.StructType([T.StructField("started_at", T.StringType())])),
    T.StructField("terminated", T.StructType([
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ])),
    T.StructField("waiting", T.StructType([T.StructField("reason", T.StringType())])),
])

CONDITION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()),
])

# One row per observed document. `seq` is the arrival number; `sync_ts` is null for
# a change event and the listing time for a row of a full listing; `listing_rows` is
# the number of members of a listing and stands on its marker row only. Ids, role,
# job and the inactive mark are top-level columns because file formats cannot prune
# or filter inside a map.
POD = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("exec_id", T.LongType()),
    T.StructField("profile_id", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("sync_ts", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("creation_ts", T.StringType()),
    T.StructField("deletion_ts", T.StringType()),
    T.StructField("restart_policy", T.StringType()),
    T.StructField("service_account", T.StringType()),
    T.StructField("volumes", T.ArrayType(T.StringType())),
    T.StructField("node_name", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("containers", T.ArrayType(CONTAINER)),
    T.StructField("conditions", T.ArrayType(CONDITION)),
    T.StructField("role", T.StringType()),
    T.StructField("inactive", T.BooleanType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("listing_rows", T.LongType()),
])

TARGETS = "app_id string, profile_id int, target int"
LEDGER = "app_id string, exec_id bigint, profile_id int, created_ms bigint"
REGISTRATIONS = "app_id string, exec_id bigint, registered_ms bigint"
JOBS = "app_id string, job_name string, exec_id bigint, phase string"
CONF = "app_id string, key string, value string"
CONF_FILES = "app_id string, file_name string, n_bytes bigint, content string"
OWNERS = "app_id string, kind string, name string, uid string, owner_uid string"
SYNCS = "app_id string, sync_ts bigint, seq bigint"
MEMBER = ["app_id", "exec_id"]
