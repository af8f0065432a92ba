"""Schemas of the backup catalogue, as DDL."""

PROGRESSION = "struct<fileSize: bigint, newFileSize: bigint, newFileCount: bigint, fileCount: bigint, speed: double, percent: double>"
SUBTASK = f"struct<context: string, description: string, state: string, failable: boolean, progress: boolean, progression: {PROGRESSION}>"
SHARE = "struct<name: string, includes: array<string>, excludes: array<string>, checksum: boolean, pathPrefix: string>"
OPERATION = f"struct<name: string, command: string, share: array<{SHARE}>, includes: array<string>, excludes: array<string>, timeout: int, authentification: boolean, username: string, password: string>"
KEEP = "struct<hourly: int, daily: int, weekly: int, monthly: int, yearly: int>"
SCHEDULE = f"struct<activated: boolean, backupPerdiod: bigint, backupToKeep: {KEEP}>"
HOST_CONFIG = f"isLocal boolean, addresses array<string>, dhcp array<struct<address: string, start: int, end: int>>, operations struct<tasks: array<{OPERATION}>, finalizeTasks: array<{OPERATION}>>, schedule {SCHEDULE}"
SCHEDULER = f"wakeupSchedule string, nightlySchedule string, defaultSchedule {SCHEDULE}"

BACKUP = (
    "number bigint, complete boolean, startDate bigint, endDate bigint, fileCount bigint, newFileCount bigint, existingFileCount bigint, "
    "fileSize bigint, existingFileSize bigint, newFileSize bigint, speed double, diskUsageStatistics map<string, struct<diskUsage: bigint, uncompressed: bigint>>"
)
BACKUPS = f"host string, pos int, {BACKUP}"
VOLUME = "struct<host: string, number: bigint, refr: bigint, excl: bigint>"
SPACE = "struct<fstype: string, size: bigint, used: bigint, free: bigint>"
QUOTAS = f"pos int, timestamp bigint, volumes array<{VOLUME}>, space {SPACE}"
TASK = f"host string, previousNumber bigint, number bigint, ip string, startDate bigint, originalStartDate bigint, subtasks array<{SUBTASK}>"
JOBS = f"id bigint, name string, state string, timestamp bigint, delay bigint, attemptsMade int, failedReason string, stacktrace array<string>, finishedOn bigint, processedOn bigint, progress double, data struct<{', '.join(f.replace(' ', ': ', 1) for f in ('host string', 'previousNumber bigint', 'number bigint', 'ip string', 'startDate bigint', 'originalStartDate bigint'))}, subtasks: array<{SUBTASK}>>"
FILES = (
    "host string, backup bigint, sharePath string, path string, name string, type string, dev bigint, ino bigint, mode bigint, nlink bigint, uid bigint, gid bigint, rdev bigint, "
    "size bigint, blksize bigint, blocks bigint, atimeMs double, mtimeMs double, ctimeMs double, birthtimeMs double"
)

#: Defaults of the scheduler configuration.
SCHEDULER_DEFAULTS = {
    "wakeupSchedule": "0 * * * *",
    "nightlySchedule": "0 0 * * *",
    "defaultSchedule": {"activated": True, "backupPerdiod": 86100, "backupToKeep": {"hourly": -1, "daily": 7, "weekly": 4, "monthly": 12, "yearly": -1}},
}
#: States of tasks, kinds of files, states of jobs.
TASK_STATES = ("WAITING", "RUNNING", "SUCCESS", "ABORTED", "FAILED")
FILE_TYPES = ("BLOCK_DEVICE", "CHARACTER_DEVICE", "DIRECTORY", "FIFO", "REGULAR_FILE", "SOCKET", "SYMBOLIC_LINK", "UNKNOWN")
JOB_STATES = ("waiting", "active", "failed", "delayed", "completed")
