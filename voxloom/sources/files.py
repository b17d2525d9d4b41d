"""Named files of binary content, written by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from voxloom.sources.shared import bounded_batches


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (name, content binary) rows as files of a folder that all machines reach (any store that Arrow knows by URI).

    A name that occurs twice is written twice, the last one stays; names may hold folders. The number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made = None
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = f"{base}/{name}"
                if made != (made := path.rpartition("/")[0]):
                    store.create_dir(made, recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    bounded_batches(rows.sparkSession)
    return rows.select("name", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0
