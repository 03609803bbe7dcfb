"""Finding files that a run needs, such as envelopes, in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

#: searched in this order below each folder
PLACES = ("", "resources", "data")


def path_exists(spark: SparkSession, path: str, delete: bool = False) -> bool:
    """Whether there is such a path; delete: removes it, with all below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.delete(at, True) if delete else system.exists(at)


def find_resource(spark: SparkSession, name: str, given: str | None = None, folders: Sequence[str] = ()) -> str:
    """The path that is given, if it is there, else the first file of this name in the folders and their PLACES.

    Then in those of this package, of the folder above it, and of the working folder. An error names all that was tried.
    """
    package = Path(__file__).resolve().parents[1]
    search = [*folders, str(package), str(package.parent), str(Path.cwd())]
    tried = [given] if given else []
    tried += ["/".join(x for x in (folder.rstrip("/"), place, name) if x) for folder in search for place in PLACES]
    for path in tried:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"{name} isn't at any of: " + ", ".join(tried))
