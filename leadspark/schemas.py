"""Table schemas; nothing is inferred from data."""

from __future__ import annotations

PROJECT = (
    "source string, external_id string, title string, location string, value bigint, description string, issued_at date, "
    "source_url string, raw_data binary, raw_type string, metadata map<string,string>, hash string"
)
RAW_INPUT = "id string, hash string, payload_type string, payload binary, source_url string, collector_name string, created_at timestamp"
LEAD = (
    "id string, raw_project_id string, raw_input_id string, source string, title string, location string, project_value bigint, "
    "general_contractor string, applicant string, contractor string, source_url string, project_type string, "
    "estimated_crew_size int, estimated_duration_months int, out_of_town_crew_likely boolean, priority_score int, "
    "priority_reason string, rationale string, suggested_outreach_timing string, notes string, status string, "
    "created_at timestamp, updated_at timestamp"
)
EMBEDDING = "lead_id string, model string, embedding array<float>, created_at timestamp"
OUTREACH = "id string, lead_id string, contact string, channel string, notes string, outcome string, logged_at timestamp"
POLL = "airport string, as_of timestamp, total bigint, cancelled bigint, rate double, ground_stop boolean"
WEATHER_ALERT = "zone string, event string, headline string, severity string, type string, as_of timestamp"
ALERT_EVENT = "airport string, ts timestamp, started_at timestamp, minutes int, state string, action string, score double"
HOTEL = (
    "id string, name string, slack_channel string, airports array<struct<code:string,distance_min:int>>, "
    "alert_threshold_sps double, distressed_rate int, rack_rate int, airline_contacts array<struct<carrier:string,ops_phone:string>>"
)
#: Answer of the enrichment model; every field must have its type.
ENRICHMENT = (
    "general_contractor string, project_type string, estimated_crew_size int, estimated_duration_months int, "
    "out_of_town_crew_likely boolean, priority_score int, priority_reason string, suggested_outreach_timing string, notes string"
)
#: Fields of the lenient signal extraction and their types.
SIGNAL = {"org_name": "string", "location": "string", "start_date": "string", "duration_days": "double", "crew_size": "double", "project_type": "string", "confidence": "double"}
