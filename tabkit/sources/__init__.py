from tabkit.sources.scratch import cleared, settle, shared_dir, shared_path, shuffles_removed, store
from tabkit.sources.tables import matrix_frame, preview, read_csv_text, read_table

__all__ = [
    "cleared",
    "matrix_frame",
    "preview",
    "read_csv_text",
    "read_table",
    "settle",
    "shared_dir",
    "shared_path",
    "shuffles_removed",
    "store",
]
