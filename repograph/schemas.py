"""The frames of the engine: a typed property graph as narrow tables, keyed by job."""

NODES = "id string, label string, node_type string, job_id string, properties string, created_at timestamp"
EDGES = "id string, source_id string, target_id string, relationship string, job_id string, properties string, created_at timestamp"

FUNCTION = "struct<name:string,line_start:int,line_end:int,is_method:boolean,parent_class:string,parameters:array<string>,decorators:array<string>,is_async:boolean,docstring:string,cyclomatic:int,branch_count:int,nesting_depth:int,call_count:int>"
CLASS = f"struct<name:string,line_start:int,line_end:int,base_classes:array<string>,methods:array<{FUNCTION}>,decorators:array<string>,docstring:string>"
IMPORT = "struct<module:string,names:array<string>,alias:string,is_relative:boolean,line:int>"
PARSED = f"job_id string, path string, language string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>, line_count int, parse_errors array<string>"

JOBS = "id string, repo_url string, artifact_type string, status string, error_message string, options map<string,string>, created_at timestamp, updated_at timestamp"
ARTIFACTS = "id string, job_id string, artifact_type string, content_type string, content_inline string, storage_path string, created_at timestamp"
FACTS = "id string, repo_url string, job_id string, category string, text string, source_symbol string, source_file string, created_at timestamp"
SUMMARIES = "id string, repo_url string, analysis_count long, headline string, overall_score int, overall_grade string, total_issues long, first_seen timestamp, updated_at timestamp"

NODE_TYPES = ("Repository", "Module", "File", "Class", "Function")
RELATIONSHIPS = ("CONTAINS", "IMPORTS", "DEPENDS_ON", "INHERITS", "CALLS", "EXHIBITS")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
SEVERITIES = ("critical", "high", "medium", "low", "info")
