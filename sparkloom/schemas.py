"""Table schemas of the code index and the project memory."""

FILES = (
    "file_id long, file_path string, file_hash string, file_size long, file_mtime long, language string, "
    "line_count int, index_level string, indexed_at long, updated_at long"
)
SYMBOLS = (
    "symbol_id long, file_id long, name string, qualified_name string, canonical_id string, scope_path string, "
    "symbol_type string, line_start int, line_end int, signature string, parent_id long"
)
CALLS = "call_id long, caller_id long, callee_name string, call_line int, callee_id long"
MEMOS = "id long, category string, entity string, act string, path string, content string, session_id string, timestamp timestamp"
TASKS = (
    "task_id string, description string, task_type string, parent_task_id string, understanding string, execution_plan string, "
    "status string, meta_data string, created_at timestamp, updated_at timestamp, completed_at timestamp, summary string, pitfalls string, current_focus string"
)
FACTS = "id long, type string, summarize string, created_at timestamp"
STATE = "key string, value string, category string, updated_at timestamp"
HOOKS = (
    "hook_id string, description string, priority string, context string, result_summary string, related_task_id string, "
    "expires_at timestamp, status string, tag string, summary string, created_at timestamp"
)
CHAINS = (
    "task_id string, description string, protocol string, status string, phases_json string, current_phase string, "
    "created_at timestamp, updated_at timestamp, reinit_count int, n_events long, n_errors long, last_error string, last_event long"
)
CHAIN_EVENTS = "id long, task_id string, phase_id string, sub_id string, event_type string, payload string, created_at timestamp"
PHASES = (
    "array<struct<id:string,name:string,type:string,status:string,input:string,summary:string,on_pass:string,on_fail:string,"
    "max_retries:int,retry_count:int,sub_tasks:array<struct<id:string,name:string,verify:string,status:string,summary:string>>>>"
)
ARCHIVE = "id long, category string, entity string, act string, path string, content string, session_id string, timestamp string"
