"""Download of a dump before any Spark job: resumed where it stopped, complete or not there."""

from __future__ import annotations

import os
import urllib.request


def download(url: str, path: str, chunk: int = 1 << 20, timeout: float = 60.0, force: bool = False) -> int:
    """Fetches url to path and returns its size. Bytes go to path.part, which a later call goes on with if the server gives
    ranges (else it begins again); only a complete file gets its name, at once. `path` is on a disk that the readers share."""
    if os.path.exists(path) and not force:
        return os.path.getsize(path)
    part = f"{path}.part"
    have = os.path.getsize(part) if os.path.exists(part) else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        resumed = answer.status == 206
        length = answer.headers.get("Content-Length")
        total = None if length is None else int(length) + (have if resumed else 0)
        with open(part, "ab" if resumed else "wb") as f:
            while data := answer.read(chunk):
                f.write(data)
    size = os.path.getsize(part)
    if total is not None and size != total:
        raise OSError(f"{url}: {size} of {total} bytes; call again to go on")
    os.replace(part, path)
    return size
