"""Parameters of the registered queries, scaled to the event spacing of the given data.

Operator defaults stay at live-system values (seconds); these are hours and days.
"""

AS_OF = "2024-01-31 00:00:00"
MONTH_START = "2024-01-01 00:00:00"
OFFLINE_AFTER_S = 6 * 3600
STALE_AFTER_S = 60 * 3600
FOR_SECONDS = 12 * 3600
COOLDOWN_S = 48 * 3600
MIN_GAP_S = 12 * 3600
HEARTBEAT_S = 3 * 86400
DEADBAND = 5.0
OUTAGE_S = 36 * 3600
LOGIN_WINDOW_S = 2 * 86400
EGRESS_WINDOW_S = 3600
RETENTION_DAYS = 21
DAY = 86400
