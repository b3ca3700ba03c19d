"""Guards on paths and files, for front doors that take them from users."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exceptions import InputError

INPUT_EXTENSIONS = {".xml", ".csv", ".ofx", ".qfx", ".mt940", ".sta", ".pdf", ".json"}
OUTPUT_EXTENSIONS = {".csv", ".xlsx", ".xls", ".json"}
MIN_BYTES, MAX_BYTES = 1, 100 << 20

_DANGER = [re.compile(p) for p in (r"\.\.", r"/\./", r"~/", r"\$\{", r"%[A-Z_]+%", "[\u200e\u200f\u202a-\u202e\u2066-\u2069]")]
#: Folders whose files aren't statements; callers may give their own.
BLOCKED = (
    *(f"/{n}" for n in "etc bin sbin usr/bin usr/sbin sys proc dev boot root System Library/System private/var/db".split()),
    *(f"C:\\{n}" for n in ("Windows", "Windows\\System32", "System32", "Program Files", "Program Files (x86)")),
)
#: First bytes of files that are no text.
BINARY = {"png": "89504e47", "gif": "47494638", "jpeg": "ffd8ff", "zip": "504b", "elf": "7f454c46", "exe": "4d5a", "ico": "00000100"}


def within(path: str, folder: str) -> bool:
    """Whether a path is a folder or below it, whatever the case and the kind of slash."""
    path, folder = (x.lower().replace("\\", "/").rstrip("/") for x in (path, folder))
    return path == folder or path.startswith(folder + "/")


def check_path(path: str, extensions: set[str] = INPUT_EXTENSIONS, blocked: tuple[str, ...] = BLOCKED) -> Path:
    """The resolved path, if nothing speaks against it."""
    if any(p.search(path) for p in _DANGER):
        raise InputError(f"the path has a pattern that isn't allowed: {path!r}")
    given = Path(path)
    real = given.resolve()
    if given.is_symlink() and real.parent != given.parent.resolve():
        raise InputError("the link leaves its folder")
    for folder in blocked:
        if any(within(p, folder) for p in (str(real), os.path.abspath(path), path)):
            raise InputError(f"files under {folder} aren't allowed")
    if real.suffix.lower() not in extensions:
        raise InputError(f"the extension isn't allowed: {real.suffix or 'none'}")
    return real


def check_input(path: str, max_bytes: int = MAX_BYTES, blocked: tuple[str, ...] = BLOCKED) -> Path:
    """A file to read: path, size and first KiB are as they should be.  PDFs count as documents."""
    real = check_path(path, INPUT_EXTENSIONS, blocked)
    if not real.is_file():
        raise InputError(f"no such file: {path}")
    size = real.stat().st_size
    if not MIN_BYTES <= size <= max_bytes:
        raise InputError(f"the size isn't allowed: {size} bytes")
    with real.open("rb") as f:
        head = f.read(1024)
    fault = content_fault(head)
    if fault and not head.startswith(b"%PDF"):
        raise InputError(fault)
    return real


def content_fault(head: bytes) -> str | None:
    for name, magic in BINARY.items():
        if head.startswith(bytes.fromhex(magic)):
            return f"the file is binary ({name})"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:  # the cut may fall within a character
            return "the file isn't UTF-8"
    return None


def content_fault_column(content: Column) -> Column:
    """The same over a column of contents; null where nothing is wrong."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for name, magic in BINARY.items():
        hit = F.startswith(head, F.lit(magic.upper()))
        out = F.when(hit, f"the file is binary ({name})") if out is None else out.when(hit, f"the file is binary ({name})")
    return out.when((F.octet_length(content) < MIN_BYTES) | (F.octet_length(content) > MAX_BYTES), "the size isn't allowed").when(~F.is_valid_utf8(content), "the file isn't UTF-8")


def check_output(path: str, blocked: tuple[str, ...] = BLOCKED) -> Path:
    real = check_path(path, OUTPUT_EXTENSIONS, blocked)
    if not real.parent.is_dir():
        raise InputError(f"no such folder: {real.parent}")
    return real


def safe_filename(name: str) -> str:
    """A name without characters that file systems refuse, 255 at most."""
    out = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).strip(". ") or "unnamed_file"
    stem, ext = os.path.splitext(out)
    return out if len(out) <= 255 else stem[: 255 - len(ext)] + ext
