"""The chunked-array data source: only asked chunks are opened, writes resume."""

import functools
import http.server
import os
import threading

import numpy as np
import pytest

from sheafray.sources import array_source as src
from sheafray.sources import arrays

SHAPE, CHUNKS = (20, 21, 9), (8, 8, 8)


@pytest.fixture
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(src.ChunkedArrays)
    return spark


def _volume() -> np.ndarray:
    v = np.random.default_rng(0).integers(1, 255, SHAPE).astype(np.uint8)
    v[8:16, :8] = 0
    return v


def _save(spark, volume, path: str, **options: str) -> None:
    whole = {"shape": ",".join(map(str, SHAPE)), "chunks": ",".join(map(str, CHUNKS)), "dtype": "uint8"} | options
    arrays.chunk_rows(spark, volume, CHUNKS).repartition(3).write.format("chunked_array").options(**whole).mode("append").save(path)


def _pasted(rows) -> np.ndarray:
    out = np.zeros([-(-n // c) * c for n, c in zip(SHAPE, CHUNKS, strict=True)], np.uint8)
    for r in rows:
        out[tuple(slice(k * c, (k + 1) * c) for k, c in zip((r.cz, r.cy, r.cx), CHUNKS, strict=True))] = np.frombuffer(bytes(r.data), np.uint8).reshape(CHUNKS)
    return out[tuple(slice(0, n) for n in SHAPE)]


def test_round_trip_with_padded_ends(source, tmp_path):
    volume, path = _volume(), f"{tmp_path}/0"
    _save(source, volume, path)
    rows = source.read.format("chunked_array").option("chunks_per_partition", "5").load(str(tmp_path)).collect()
    assert (_pasted(rows) == volume).all() and len(rows) == 3 * 3 * 2 - 2
    # Beyond the array's end the last values go on.
    last = next(r for r in rows if (r.cz, r.cy, r.cx) == (2, 2, 1))
    block = np.frombuffer(bytes(last.data), np.uint8).reshape(CHUNKS)
    assert (block[4:] == block[3]).all() and (block[:, 5:] == block[:, 4:5]).all() and (block[..., 1:] == block[..., :1]).all()
    assert src.available(path) == [(0, 6), (8, 18)]
    assert (_pasted(arrays.read_chunks(source, path).collect()) == volume).all()


@pytest.mark.parametrize("where", ["cz = 2", "cz > 1 and cy <= 1", "cz in (0, 2) and cx = 0", "cz >= 1 and cz < 2", "cz in (7, 9)", "cz = 0 and cz = 1", "cx + cy = 2"])
def test_only_chunks_asked_for_are_opened(source, tmp_path, where):
    path = f"{tmp_path}/a"
    _save(source, _volume(), path)
    df = source.createDataFrame([(z, y, x) for z in range(3) for y in range(3) for x in range(2) if (z, y) != (1, 0)], "cz int, cy int, cx int")
    wanted = {tuple(r) for r in df.where(where).collect()}
    if "+" not in where:  # that one cannot be pushed: every chunk is read
        for name in os.listdir(path):
            if not name.startswith(".") and tuple(map(int, name.split("."))) not in wanted:
                with open(f"{path}/{name}", "wb") as f:
                    f.write(b"not a chunk")
    got = source.read.format("chunked_array").load(path).where(where).collect()
    assert {(r.cz, r.cy, r.cx) for r in got} == wanted


def test_a_write_that_died_is_run_again(source, tmp_path):
    volume, path = _volume(), f"{tmp_path}/b"
    broken = arrays.chunk_rows(source, volume, CHUNKS).selectExpr("if(cz = 2 and cy = 2, 99, cz) cz", "cy", "cx", "data")
    options = {"shape": ",".join(map(str, SHAPE)), "chunks": ",".join(map(str, CHUNKS)), "dtype": "uint8"}
    with pytest.raises(Exception, match="outside"):
        broken.repartition(4).write.format("chunked_array").options(**options).mode("append").save(path)
    assert not os.path.exists(f"{path}/.zarray")
    for _ in range(2):
        _save(source, volume, path, resume="true")
        assert (_pasted(source.read.format("chunked_array").load(path).collect()) == volume).all()
        assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == sorted(f"{z}.{y}.{x}" for z in range(3) for y in range(3) for x in range(2) if (z, y) != (1, 0))
        assert src.available(path) == [(0, 6), (8, 18)]


def test_levels_of_a_url(source, tmp_path):
    volume = _volume()
    _save(source, volume, f"{tmp_path}/1")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        for spec in (url, f"{url}/1", f"{url}/1/"):
            got = source.read.format("chunked_array").option("level", "1").load(spec).where("cy = 1").collect()
            assert {r.cy for r in got} == {1} and len(got) == 6
    finally:
        server.shutdown()
    with pytest.raises(Exception, match="no array"):
        source.read.format("chunked_array").load(f"{tmp_path}/nothing").collect()
