"""Resumable copies of remote objects into a folder that all executors reach."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from .array_source import _put, _system


def _held(path: str) -> int | None:
    """A file's size, or None where there is none."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def ingest(objects: DataFrame, root: str, attempts: int = 4, pause: float = 1.0, timeout: float = 60.0) -> DataFrame:
    """Copy ``objects`` (url, path, size; size may be null) below ``root``:
    (path, status, bytes, tries).

    A file that is there with its size is left alone ("present"). Otherwise the
    object is fetched, again after an error or a size that differs, written to
    another name and moved ("fetched"), so that a file is whole or not there and
    a repeated task changes nothing. "missing" objects (403, 404) leave no file;
    "failed" ones have used up their attempts, and can be asked for again.
    """
    import urllib.error
    import urllib.request

    def copy(url: str, path: str, size) -> tuple[str, int, int]:
        target = f"{root.rstrip('/')}/{path}"
        there = _held(target)
        if there is not None and (size is None or there == size):
            return "present", there, 0
        for k in range(attempts):
            try:
                with urllib.request.urlopen(url, timeout=timeout) as r:
                    content = r.read()
                    said = r.headers.get("Content-Length")
                if (said is None or int(said) == len(content)) and (size is None or size == len(content)):
                    _put(target, content)
                    return "fetched", len(content), k + 1
            except urllib.error.HTTPError as e:
                if e.code in (403, 404):
                    return "missing", 0, k + 1
            except OSError:
                pass
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
        return "failed", 0, attempts

    def run(batches):
        import pandas as pd

        for rows in batches:
            done = [copy(u, p, None if pd.isna(n) else int(n)) for u, p, n in zip(rows["url"], rows["path"], rows["size"], strict=True)]
            yield pd.DataFrame({"path": rows["path"], "status": [d[0] for d in done], "bytes": [d[1] for d in done], "tries": [d[2] for d in done]})

    return objects.select("url", "path", "size").mapInPandas(run, "path string, status string, bytes long, tries int")
