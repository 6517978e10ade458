"""Schemas of the feeds and landing tables."""

from __future__ import annotations

VEHICLE_PASS = "vehicle_id string, road_id string, device_id string, pass_time string, speed string, direction string, plate_number string, vehicle_type string, lane string"
TRAFFIC_STATUS = "road_id string, avg_speed string, traffic_flow string, jam_level string, congestion_rate string, peak_flag string, sample_time string"
DEVICE_STATUS = "device_id string, cpu_usage string, memory_usage string, temperature string, online_flag string, heartbeat_time string, signal_strength string, device_type string"
ALARM_LOG = "alarm_id string, device_id string, alarm_type string, alarm_level string, alarm_content string, alarm_time string, recover_time string, recover_status string"
FEEDS = {"traffic_vehicle": VEHICLE_PASS, "traffic_status": TRAFFIC_STATUS, "device_status": DEVICE_STATUS, "device_alarm": ALARM_LOG}
CDC = "database string, `table` string, type string, ts long, xid long, xoffset long, data map<string,string>, old map<string,string>"
LOG = "timestamp string, job string, level string, message string, password string, secret string, token string"
#: Most bad rows and most bad share (per cent) of each extract.
BAD_BUDGETS = {"road": (0, 2.0), "device": (10, 5.0), "area": (0, 1.0)}
#: Tables of one run in layer order and the days that a backfill may reach back.
MAX_BACKFILL_DAYS = 90
RETENTION_DAYS = 90
