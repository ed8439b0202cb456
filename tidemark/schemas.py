"""Schemas (DDL) of the activity-log tables; all times are epoch seconds."""


COMMANDS = "user_id long, id long, timestamp long, command string, exit_code int, duration int, session_id long, project_id long, is_legacy boolean, recovery_source string"
SESSIONS = "user_id long, id long, start_time long, end_time long, duration_seconds long, project_id long, ai_summary string, is_legacy boolean, tags string"
PROJECTS = "id long, name string, path string, first_seen long, last_seen long, project_context string"
COMMITS = "hash string, timestamp long, message string, cleaned_message string, project_id long, user_id long"
SUMMARIES = "timeframe_id string, type string, summary string, created_at long"
SNAPSHOTS = "session_id long, source string, payload string, captured_at long"
CONSOLIDATED = "start_time long, end_time long, summary string, commands array<string>"

OTHER = "Other"
NO_PROJECT = "General / No Project"
