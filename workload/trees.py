"""A tree of source files that tasks write, list and read."""

import os
import uuid
from collections.abc import Iterator

import pandas as pd

from auditweave.plans.joins import shared_folder
from auditweave.sinks.committed import shared
from auditweave.sources import files as src
from auditweave.sources import tree
from workload.base import query
from workload.views import src_files, with_views

WRITABLE = "project IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL"


def planted(spark, sf_dir) -> str:
    """The source files of the workload as a tree in the shared folder; returns its root."""
    root = f"{shared(shared_folder(spark))}/tree-{uuid.uuid4().hex}"
    os.makedirs(root)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                place = os.path.join(root, row.project, row.path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "w", encoding="utf-8", newline="") as file:
                    file.write(row.content)
            yield pd.DataFrame({"n": [len(frame)]})

    src_files(spark, sf_dir).where(WRITABLE).select("project", "path", "content").mapInPandas(write, "n long").count()
    return root


@query("listed_tree", with_views(
    "SELECT project, path, CAST(strlen(content) AS bigint) AS size_bytes, content FROM src_files WHERE " + WRITABLE, "src_files"))
def listed_tree(spark, sf_dir):
    root = planted(spark, sf_dir)
    files = src.decoded(tree.with_contents(tree.list_tree(spark, root), root))
    return files.select("project", "path", "size_bytes", "content")
