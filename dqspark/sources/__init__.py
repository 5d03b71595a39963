"""Where tables come from and where results go."""

from .counts import carry_counts, read_counts, write_counts
from .dashboard import record_release
from .logs import append_runs, new_run, read_metrics, read_runs, save_metrics
from .states import read_states, save_state
from .tables import jdbc_options, read_files, read_jdbc

__all__ = [
    "append_runs", "carry_counts", "jdbc_options", "new_run", "read_counts", "read_files", "read_jdbc", "read_metrics",
    "read_runs", "read_states", "record_release", "save_metrics", "save_state", "write_counts",
]
