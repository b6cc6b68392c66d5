"""Files by byte ranges: what tasks use where a file is too large to be read whole.

Any address that Arrow's file systems know will do (local paths, file:, s3:, gs:, hdfs:), and web addresses, which are read by requests
for ranges and never written.  A task opens files itself, so the driver and
Spark's readers never hold their content.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from gridloom import ship

#: Seconds that a web server may take, and how often it is asked again when it fails or does not answer.
PATIENCE, TRIES = 30, 4

#: Bytes fetched at least, so that the many small reads of a header are few requests.
BLOCK = 1 << 16


def locate(address: str):
    """File system and path of an address; Hadoop's ``file:/a`` counts as ``file:///a``."""
    if address.startswith("file:") and not address.startswith("file://"):
        address = "file://" + address.removeprefix("file:")
    return FileSystem.from_uri(address if "://" in address else f"file://{address}")


def on_web(address: str) -> bool:
    return address.lower().startswith(("http://", "https://"))


def ask(address: str, span: tuple[int, int] | None = None, method: str = "GET") -> tuple[bytes, dict]:
    """Body and headers of a web answer, for the bytes ``span`` where given; a server that sends all of a file instead has it cut here.
    What is not there raises FileNotFoundError; failures of the server and of the line are tried again."""
    url = urllib.parse.quote(address, safe=":/?&=%~+,;@!$'()*[]")
    request = urllib.request.Request(url, method=method, headers={"Range": f"bytes={span[0]}-{span[1] - 1}"} if span else {})
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=PATIENCE) as answer:
                body = answer.read()
                return (body[span[0] : span[1]] if span and answer.status == 200 else body), {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise FileNotFoundError(address) from None
            if e.code == 416:
                return b"", {}
            if e.code < 500 and e.code != 429 or attempt == TRIES - 1:
                raise
        except OSError:
            if attempt == TRIES - 1:
                raise
        time.sleep(0.2 * 2**attempt)
    raise OSError(address)


class WebFile:
    """A file on the web, as far as readers by range need one."""

    def __init__(self, address: str):
        self.address = address
        said = ask(address, method="HEAD")[1].get("content-length")
        if said is None:  # a server that does not say it: the range of the first byte does
            said = ask(address, (0, 1))[1].get("content-range", "").rpartition("/")[2]
        self.length = int(said)

    def size(self) -> int:
        return self.length

    def read_at(self, size: int, start: int) -> bytes:
        return ask(self.address, (start, min(start + size, self.length)))[0] if start < self.length and size > 0 else b""

    def close(self) -> None:
        pass


class Ranged:
    """The bytes of a file by slices, as those of a ``bytes`` object; counts what it fetched."""

    def __init__(self, address: str):
        if on_web(address):
            self.file = WebFile(address)
        else:
            fs, path = locate(address)
            self.file = fs.open_input_file(path)
        self.length = self.file.size()
        self.start, self.held, self.fetched = 0, b"", 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, where: slice) -> bytes:
        start, stop, _ = where.indices(self.length)
        if start >= stop:
            return b""
        if start < self.start or stop > self.start + len(self.held):
            size = min(max(stop - start, BLOCK), self.length - start)
            self.start, self.held = start, self.file.read_at(size, start)
            self.fetched += len(self.held)
        return self.held[start - self.start : stop - self.start]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def read_range(address: str, offset: int, length: int) -> bytes:
    if on_web(address):
        return ask(address, (offset, offset + length))[0] if length else b""
    fs, path = locate(address)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def length(address: str) -> int | None:
    """Bytes of a file; None where there is none."""
    if on_web(address):
        try:
            return WebFile(address).size()
        except FileNotFoundError:
            return None
    fs, path = locate(address)
    found = fs.get_file_info(path)
    return found.size if found.is_file else None


def read_whole(address: str) -> bytes | None:
    """A small document; None where there is none."""
    try:
        if on_web(address):
            return ask(address)[0]
        fs, path = locate(address)
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


def put(address: str, data: bytes) -> None:
    """Write a file whole; running twice leaves the same file."""
    fs, path = locate(address)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The column ``path`` of the files at addresses or in folders; Spark's reader lists them and opens none.  Web addresses name files."""
    ship(spark)
    given = [paths] if isinstance(paths, str) else list(paths)
    web, other = [p for p in given if on_web(p)], [p for p in given if not on_web(p)]
    found = spark.createDataFrame([(p,) for p in web], "path string") if web else None
    if not other:
        return found if web else spark.createDataFrame([], "path string")
    listed = spark.read.format("binaryFile").load(other).select("path")
    return listed.unionByName(found) if web else listed
