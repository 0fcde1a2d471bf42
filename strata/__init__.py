"""strata: a PySpark-native engine for lake tables and file inventories.

The most used entry points are re-exported here; everything else lives in
``sources``, ``sinks``, ``functions``, ``operators``, ``plans`` and
``streaming``.
"""

from strata.operators.relationships import column_profile, er_edges, fk_ddl, infer_relationships
from strata.operators.insight import children_per_parent, insight_queries, orphans, top_parents
from strata.operators.relational import latest_per_key, rank_in_group, top_in_group
from strata.operators.cleaning import clean_csv_dir, process_csv_folder
from strata.operators.documents import push_documents, upsert_documents
from strata.plans.files import backup_plan, commit_backup, retention_plan, sync_plan, upload_plan
from strata.plans.routing import route_numbers, route_projects
from strata.session import get_session, materialize, scratch_path
from strata.sources.files import load_tables, read, read_csv
from strata.sources.inventory import inventory
from strata.streaming.admit import admit_stream, admit_tick
from strata.streaming.watch import read_watch, run_watch, watch

__all__ = [
    "admit_stream", "admit_tick", "backup_plan", "children_per_parent", "clean_csv_dir",
    "column_profile", "commit_backup", "er_edges", "fk_ddl", "get_session", "infer_relationships",
    "insight_queries", "inventory", "latest_per_key", "load_tables", "materialize", "orphans",
    "process_csv_folder", "push_documents", "rank_in_group", "read", "read_csv", "retention_plan",
    "route_numbers", "route_projects", "read_watch", "run_watch", "scratch_path", "sync_plan", "top_in_group",
    "top_parents", "upload_plan", "upsert_documents", "watch",
]
