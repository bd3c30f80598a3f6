"""Schema migrations: snapshots of declared schemas, differences, operations on a store, and their history."""

from .ddl import AlterTable, MigrationError, alter_enum, alter_table, create_enum, create_index, create_schema, create_sequence, create_table, custom, drop_enum, drop_index, drop_schema, drop_sequence, drop_table, rename_table, replay
from .diff import diff
from .runner import Migrations
from .snapshot import snapshot

__all__ = [
    "AlterTable", "MigrationError", "Migrations", "alter_enum", "alter_table", "create_enum", "create_index", "create_schema", "create_sequence", "create_table", "custom", "diff", "drop_enum", "drop_index", "drop_schema", "drop_sequence", "drop_table",
    "rename_table", "replay", "snapshot",
]
