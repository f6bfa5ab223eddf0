"""Downloading releases, with checks. Everything here is small work of the driver."""

from __future__ import annotations

import hashlib
import os
import shutil
import socket
import tempfile
import urllib.request
from collections.abc import Callable
from pathlib import Path

#: Environment variables: where a release is, where it is kept, one that is there already, and a folder of reports.
URL, CACHE, FULL, DATA = "AMPLIREF_DB_URL", "AMPLIREF_CACHE_DIR", "AMPLIREF_DB", "AMPLIREF_DATA_DIR"
CONF_URL = "ampliref.db.url"
DEFAULT_URL = ""
FILENAME = "reference.db"

Downloader = Callable[[str, str, bool], None]


def db_url(spark=None) -> str:
    """The environment's, else the session's setting, else the default; a setting of "" is taken as it is."""
    if os.environ.get(URL):
        return os.environ[URL]
    found = spark.conf.get(CONF_URL, None) if spark is not None else None
    return DEFAULT_URL if found is None else found


def db_dir(create: bool = True) -> str:
    path = Path(os.environ.get(CACHE) or Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local/share") / "ampliref")
    if create:
        path.mkdir(parents=True, exist_ok=True)
    return str(path.resolve())


def db_path(filename: str = FILENAME) -> str:
    return str(Path(db_dir()) / filename)


def available(path: str | None = None) -> bool:
    path = db_path() if path is None else path
    return bool(path) and Path(path).exists()


def _near(*names: str) -> str:
    """The first of names in the working folder or three above it."""
    here = Path.cwd()
    for top in [here, *list(here.parents)[:3]]:
        for n in names:
            if (top / n).exists():
                return str(top / n)
    return ""


def find_full() -> str:
    for p in (os.environ.get(FULL, ""), db_path() if available() else "", _near(f"release/{FILENAME}")):
        if p and Path(p).exists():
            return p
    return ""


def find_data_dir() -> str:
    own = os.environ.get(DATA, "")
    return own if own and Path(own).is_dir() else _near("release")


def default_data_file(filename: str, bundled: str | None = None) -> str:
    """A report in the data folder, a bundled folder, or ./data; '' if there is none."""
    for top in (find_data_dir(), bundled or "", "data"):
        if top and (Path(top) / filename).exists():
            return str(Path(top) / filename)
    return ""


def download_file(url: str, dest: str, quiet: bool = True) -> None:
    """A local path or file:// is copied; else HTTP."""
    local = url.removeprefix("file://")
    if "://" not in local and Path(local).exists():
        shutil.copyfile(local, dest)
        return
    with urllib.request.urlopen(url) as r, open(dest, "wb") as f:  # noqa: S310  the user's own address
        shutil.copyfileobj(r, f)


def download_with_retries(url: str, dest: str, quiet: bool = True, timeout: float = 3600, retries: int = 3, downloader: Downloader = download_file) -> str:
    """At least one attempt; what an attempt left is removed before the next. The time limit is at least the former one, which comes back."""
    before = socket.getdefaulttimeout()
    socket.setdefaulttimeout(max(timeout, before or 0))
    last: Exception | None = None
    try:
        for _ in range(max(1, retries)):
            Path(dest).unlink(missing_ok=True)
            try:
                downloader(url, dest, quiet)
            except Exception as e:  # whatever a downloader raises
                last = e
                continue
            if Path(dest).exists():
                return dest
        raise OSError(f"Download failed after {max(1, retries)} attempt(s): {last}")
    finally:
        socket.setdefaulttimeout(before)


def checksum(path: str, kind: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind).hexdigest()


def install(url: str, destfile: str | None = None, overwrite: bool = False, md5: str | None = None, sha256: str | None = None, min_bytes: int = 1, quiet: bool = True, timeout: float = 3600, retries: int = 3, downloader: Downloader = download_file, manifest=None) -> str:
    """Downloads to a temporary file, checks size and checksums, then puts it in place. A file that is there stays unless overwritten.

    manifest: a release whose own address makes its size and checksum binding.
    """
    destfile = destfile or db_path()
    if Path(destfile).exists() and not overwrite:
        return str(Path(destfile).resolve())
    if not url:
        raise ValueError(f"No download address is configured. Set {URL}, the setting {CONF_URL}, or pass url.")
    if manifest is not None and url == manifest.url:
        md5, min_bytes = md5 or manifest.md5 or None, max(min_bytes, manifest.size_bytes)
    Path(destfile).parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=Path(destfile).parent) as d:
        part = download_with_retries(url, str(Path(d) / "part"), quiet, timeout, retries, downloader)
        size = Path(part).stat().st_size
        if size < min_bytes:
            raise ValueError(f"Downloaded file is too small: {size} bytes, at least {min_bytes} expected")
        for kind, want in (("md5", md5), ("sha256", sha256)):
            if want and (got := checksum(part, kind)) != want.lower():
                raise ValueError(f"{kind} mismatch: expected {want}, got {got}")
        os.replace(part, destfile)
    return str(Path(destfile).resolve())
