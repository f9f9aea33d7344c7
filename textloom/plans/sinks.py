"""One output file for each document, in a tree that mirrors the input's."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import renderers


def put(uri: str, data: bytes) -> int:
    """Write a file whole or not at all, so that a task that is repeated only repeats it."""
    if urlparse(uri).scheme in ("", "file"):
        path = urlparse(uri).path if uri.startswith("file:") else uri
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, path)
    return len(data)


def with_target(df: DataFrame, source: str, target: str, extension: str, keep_extension: bool = True) -> DataFrame:
    """Adds ``target``: the place of ``path`` in the mirrored tree."""
    local = F.regexp_replace("path", "^file:/*", "/")
    return df.withColumn("target", renderers.output_path(local, source, target, F.lit(extension), keep_extension))


def write_files(df: DataFrame, text: str = "text", target: str = "target", render: Callable[[str], str] | None = None) -> DataFrame:
    """Write each row's text to its target when the result is read: ``df`` without the text, with written bytes and error.

    A null text or target writes nothing; a failure is its row's error. The texts pass through once; ``render`` is applied to them.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("written_bytes", T.LongType()), T.StructField("write_error", T.StringType())])

    def run(batches):
        for b in batches:
            size, error = [], []
            for t, where in zip(b[text], b[target], strict=True):
                n = e = None
                if t is not None and where is not None:
                    try:
                        n = put(where, (render(t) if render else t).encode("utf-8"))
                    except Exception as x:
                        e = f"{type(x).__name__}: {x}"
                size.append(n)
                error.append(e)
            out = b[[f.name for f in kept]].copy()
            out["written_bytes"] = pd.array(size, dtype="Int64")
            out["write_error"] = error
            yield out

    return df.mapInPandas(run, schema)
