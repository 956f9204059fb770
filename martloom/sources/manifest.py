"""Which loads make up each partition of a raw table.

Loads are written to folders of their own, ``{table}/_load=<id>/year=YYYY/month=MM``, and never moved. A numbered manifest
names the loads of each partition; the one with the highest number holds. A writer adds the next number, which fails if another
writer was first, and then begins again from that writer's manifest. So readers see one load set or the next, and loads that run at
the same time can't undo each other.
"""

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from martloom.sources.storage import Folder

LOAD = "_load"
_FOLDER = "_manifests"
# partition path -> (run id, load id) of its loads
Parts = dict[str, list[list[str]]]


def _newest(folder: Folder) -> int:
    return max((int(name[:-5]) for name, is_dir in folder.list(_FOLDER) if not is_dir and name.endswith(".json") and name[:-5].isdigit()), default=0)


def _read(folder: Folder, number: int) -> Parts:
    return json.loads(folder.read_text(f"{_FOLDER}/{number:012d}.json")) if number else {}


def current(spark: SparkSession, root: str) -> Parts | None:
    """The parts of the newest manifest, None for a table that has none."""
    folder = Folder(spark, root)
    number = _newest(folder)
    return _read(folder, number) if number else None


def commit(folder: Folder, change: Callable[[Parts], Parts]) -> None:
    """Apply a change to the newest parts; repeated while other writers are faster."""
    while True:
        number = _newest(folder)
        if folder.write_new(f"{_FOLDER}/{number + 1:012d}.json", json.dumps(change(_read(folder, number)), sort_keys=True)):
            return


def paths(root: str, parts: Parts) -> list[str]:
    return [f"{root.rstrip('/')}/{LOAD}={load}/{part}" for part, loads in sorted(parts.items()) for _, load in loads]
