from .drains import drain_geocoding, sales_refresh_stream
from .feeds import (
    job_events_stream, job_state_stream, keep_job_states, keep_latest, parse_job_events, parse_web_vitals,
    read_job_states, read_recent, recent_events, run_append, web_vitals_stream,
)
