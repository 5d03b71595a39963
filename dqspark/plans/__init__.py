"""Plan shapes shared by the operators."""

from .once import computed_once
from .skew import hot_keys, hot_keys_of, key_counts, null_safe_join, salted_join, shuffle_partitions

__all__ = ["computed_once", "hot_keys", "hot_keys_of", "key_counts", "null_safe_join", "salted_join", "shuffle_partitions"]
