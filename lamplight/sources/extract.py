"""Text of files by format. Formats that need a program say so where the program is absent."""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import os
import re
import shutil
import subprocess
import tarfile
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lamplight.settings import Settings
from lamplight.sources.charset import decode

# Extensions by family, parts of office files, limits.
TEXT = (".txt", ".md", ".markdown", ".csv", ".tsv", ".log", ".json", ".xml", ".html", ".htm", ".yaml", ".yml", ".ini", ".cfg", ".rtf", ".srt", ".vtt")
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".h", ".cpp", ".cs", ".go", ".rs", ".rb", ".php", ".sql", ".sh", ".ps1", ".bat", ".r", ".css", ".scss")
MAIL = (".eml", ".wdseml", ".emlx")
IMAGE = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif", ".heic")
AUDIO, VIDEO = (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".opus"), (".mkv", ".mp4", ".mov", ".m4v", ".avi", ".webm")
MEDIA = AUDIO + VIDEO
ARCHIVE = (".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar")
OFFICE = {".docx": ("docx", ("word/",)), ".xlsx": ("xlsx", ("xl/",)), ".xlsm": ("xlsx", ("xl/",)), ".pptx": ("pptx", ("ppt/slides/", "ppt/notesSlides/")), ".odt": ("odf", ("content.xml",)), ".ods": ("odf", ("content.xml",)), ".odp": ("odf", ("content.xml",))}
MAIL_HEADERS = ("Subject", "From", "To", "Cc", "Date")
ARCHIVE_FILES, ARCHIVE_DEPTH = 10_000, 4
PAGE_CHARS = 20
# The text that rows of lock files hold, and the titles of the parts of media texts.
LOCK_TEXT = "Temporary Office lock file; no document body exists."
MEDIA_TITLES = ("[Audio transcript]", "[Video frame OCR]")


class Encrypted(Exception):
    """The document needs a password."""


class Unsupported(Exception):
    """A program this format needs is not there."""


@dataclass
class Extracted:
    text: str = ""
    method: str = "name-only"
    ocr_used: int = 0
    pages: int = 0
    segments: list[tuple[int, str]] = field(default_factory=list)


def failure(e: BaseException) -> str:
    """Class of a failure by its type, never by its message."""
    for x in _chain(e):
        if isinstance(x, Encrypted):
            return "encrypted"
        if isinstance(x, Unsupported):
            return "unsupported"
        if isinstance(x, FileNotFoundError):
            return "io-not-found"
        if isinstance(x, PermissionError):
            return "io-denied"
        if isinstance(x, (TimeoutError, subprocess.TimeoutExpired)):
            return "timeout"
        if isinstance(x, (zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, UnicodeError, EOFError)):
            return "decode"
    return "unknown"


def _chain(e: BaseException | None) -> Iterator[BaseException]:
    while e is not None:
        yield e
        e = e.__cause__ or e.__context__


def strip_tags(html: str) -> str:
    return re.sub(r"<[^>]*$", "", re.sub(r"<[^>]*>", " ", html)).replace(">", " ")


def mail(raw: bytes, most: int) -> str:
    """Headers, bodies depth first (markup stripped), names of attachments; a line each. A first line that
    only counts the bytes of the message, as some mail programs store it, is left out."""
    count, _, rest = raw.partition(b"\n")
    raw = rest if count.strip().isdigit() else raw
    m = email.message_from_bytes(raw, policy=email.policy.default)
    out = [f"{h}: {m[h]}" for h in MAIL_HEADERS if m[h] is not None]
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_type() in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except (LookupError, UnicodeError):
                body = (part.get_payload(decode=True) or b"").decode("latin-1")
            out.append(body if part.get_content_type() == "text/plain" else strip_tags(body))
        if (name := part.get_filename()) and part.get("Content-Disposition"):
            out.append(f"[attachment: {name}]")
    return "\n".join(out)[:most]


def xml_text(raw: bytes, odf: bool = False) -> list[str]:
    """Texts of elements named t or v; in OpenDocument files of paragraphs and headings."""
    wanted = {"p", "h"} if odf else {"t", "v"}
    out = []
    for _, e in ElementTree.iterparse(io.BytesIO(raw)):
        if e.tag.rsplit("}", 1)[-1] in wanted:
            x = "".join(e.itertext()).strip() if odf else (e.text or "").strip()
            if x:
                out.append(x)
    return out


def office(raw: bytes, method: str, prefixes: tuple[str, ...], most: int) -> Extracted:
    parts: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if info.filename.endswith(".xml") and info.filename.startswith(prefixes):
                if info.flag_bits & 1:
                    raise Encrypted(info.filename)
                parts += xml_text(z.read(info), method == "odf")
    return Extracted("\n".join(parts)[:most], method)


def page_segments(text: str, most: int | None = None) -> list[tuple[int, str]]:
    """Pages between form feeds, counted from 1, blank ones left out, within a budget of characters."""
    out, left = [], len(text) if most is None else most
    for k, page in enumerate(text.split("\f"), 1):
        if page.strip() and left > 0:
            out.append((k, page[:left]))
            left -= len(page)
    return out


def run(program: str, *args: str, seconds: int = 120) -> bytes:
    if not shutil.which(program):
        raise Unsupported(program)
    done = subprocess.run([program, *args], capture_output=True, timeout=seconds)
    if b"password" in done.stderr.lower():
        raise Encrypted(args[-1])
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace")[:200])
    return done.stdout


def needs_ocr(mode: str, chars: int, pages: int) -> bool:
    return mode == "on" or (mode == "auto" and chars < PAGE_CHARS * max(pages, 1))


def page_count(path: str, layer: str) -> int:
    """Pages by the program that knows them, else by the form feeds of the text layer."""
    try:
        found = re.search(rb"^Pages:\s*(\d+)", run("pdfinfo", path), re.M)
    except (Unsupported, ValueError):
        found = None
    return int(found.group(1)) if found else layer.count("\f") or 1


def recognised(path: str, s: Settings) -> str:
    """Text of an image by the installed program: page segmentation as set, once more as one block if blank."""
    for mode in dict.fromkeys((s.ocr_psm, 6)):
        text = run("tesseract", path, "stdout", "--psm", str(mode)).decode(errors="replace")
        if text.strip():
            return text
    return ""


def image(path: str, s: Settings, tool: Callable[[str], str] | None = None) -> Extracted:
    """Recognised text of an image; HEIC is turned into a JPEG first. Without a program or tool, only the name."""
    read = tool or ((lambda p: recognised(p, s)) if shutil.which("tesseract") else None)
    if read is None or s.ocr == "off":
        return Extracted()
    if path.lower().endswith(".heic") and shutil.which("ffmpeg"):
        with tempfile.TemporaryDirectory() as at:
            frame = os.path.join(at, "frame.jpg")
            run("ffmpeg", "-nostdin", "-loglevel", "error", "-y", "-i", path, "-frames:v", "1", frame, seconds=60)
            text = read(frame)
    else:
        text = read(path)
    return Extracted(text, "ocr", int(bool(text.strip())), 1)


def clock(hundredths: int) -> str:
    """hh:mm:ss of hundredths of a second."""
    s = hundredths // 100
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def media(path: str, s: Settings, tools: dict) -> Extracted:
    """Transcript and, of a video, the texts of its frames, each once.

    tools: media gives the transcript, as text or as (start, stop, text) in hundredths of a second;
    frames gives the images of a video to be recognised by image, or they are made every 30 seconds.
    """
    if "media" not in tools:
        raise Unsupported("transcription")
    said = tools["media"](path)
    if not isinstance(said, str):
        said = "\n".join(f"[{clock(a)}-{clock(b)}] {t.strip()}" for a, b, t in said if t.strip())
    parts, ext = [f"{MEDIA_TITLES[0]}\n{said}"], os.path.splitext(path)[1].lower()
    read, frames = tools.get("image") or ((lambda p: recognised(p, s)) if shutil.which("tesseract") else None), 0
    if ext in VIDEO and read is not None and s.ocr != "off":
        with tempfile.TemporaryDirectory() as at:
            shown = tools["frames"](path) if "frames" in tools else _stills(path, at)
            frames = len(shown)
            seen = "\n".join(dict.fromkeys(t for f in shown if (t := read(f).strip())))
        parts += [f"{MEDIA_TITLES[1]}\n{seen}"] if seen else []
    most = (1 << 62) if s.exhaustive else s.max_chars
    return Extracted("\n\n".join(parts)[:most], "video-transcript-ocr" if ext in VIDEO else "audio-transcript", int(frames > 0), frames)


def _stills(path: str, folder: str) -> list[str]:
    """Frames of a video, one in 30 seconds, at most 1,000; none where the program is absent or fails."""
    try:
        run("ffmpeg", "-nostdin", "-loglevel", "error", "-y", "-i", path, "-vf", "fps=1/30,scale='min(1920,iw)':-2", "-frames:v", "1000", os.path.join(folder, "%06d.png"), seconds=1800)
    except (Unsupported, ValueError):
        return []
    return sorted(os.path.join(folder, f) for f in os.listdir(folder))


def pdf(path: str, s: Settings, ocr: Callable[[str], str] | None = None) -> Extracted:
    """Text layer by pages; recognised text joins it where the layer is thin, and only if longer."""
    layer = run("pdftotext", "-layout", path, "-").decode(errors="replace")
    segments = page_segments(layer, s.max_chars)
    text = "".join(x for _, x in segments)
    pages = page_count(path, layer)
    if ocr and needs_ocr(s.ocr, len(text.strip()), pages):
        seen = ocr(path)
        if len(seen.encode()) > len(text.encode()):
            return Extracted(f"{text}\n{seen}"[: s.max_chars], "pdf-ocr", 1, pages)
    return Extracted(text, "pdf-text", 0, pages, segments)


def pdf_exhaustive(path: str, s: Settings, ocr: Callable[[str], str] | None = None) -> Extracted:
    """Text layer and recognised text of every page, which ocr gets as an image; without ocr it is unsupported."""
    if ocr is None:
        raise Unsupported("recognition of PDF pages")
    layers = run("pdftotext", "-layout", path, "-").decode(errors="replace").split("\f")
    segments, used = [], 0
    for k, layer in enumerate(layers[: max(1, len(layers) - 1)], 1):
        with tempfile.TemporaryDirectory() as at:
            run("pdftoppm", "-f", str(k), "-l", str(k), "-singlefile", "-png", "-r", str(s.ocr_dpi), path, os.path.join(at, "page"))
            seen = ocr(os.path.join(at, "page.png"))
        parts = [f"[{what}]\n{x}" for what, x in (("Text layer", layer), ("OCR", seen)) if x.strip()]
        used |= bool(seen.strip())
        segments.append((k, "\n".join(parts) or f"[Page {k}: no textual content detected]"))
    text = "\n\n".join(f"[Page {k}]\n{x}" for k, x in segments)
    return Extracted(text, "pdf-exhaustive-ocr" if used else "pdf-exhaustive-text", int(used), len(segments), segments)


def _members(raw: bytes, name: str) -> Iterator[tuple[str, bytes | None]]:
    """(name, content) of the members, content None where it needs a password."""
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
                yield i.filename, None if i.flag_bits & 1 else z.read(i)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for i in sorted((i for i in t.getmembers() if i.isfile()), key=lambda i: i.name):
                yield i.name, t.extractfile(i).read()
        return
    except tarfile.ReadError:
        pass
    import bz2
    import gzip
    import lzma

    opener = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress}.get(os.path.splitext(name)[1].lower())
    if opener is None:  # other archives by the program that reads them
        with tempfile.NamedTemporaryFile(suffix=os.path.splitext(name)[1]) as f:
            f.write(raw)
            f.flush()
            for member in sorted(run("bsdtar", "-tf", f.name).decode(errors="replace").splitlines()):
                if not member.endswith("/"):
                    try:
                        yield member, run("bsdtar", "-xOf", f.name, member)
                    except (Encrypted, ValueError):
                        yield member, None
        return
    yield os.path.splitext(name)[0], opener(raw)


def archive(raw: bytes, name: str, s: Settings, depth: int) -> Extracted:
    """Sections of the members, sorted; unsafe names are left out, a failing member makes it partial."""
    parts, used, bad, most = [], 0, False, (1 << 62) if s.exhaustive else s.max_chars
    for k, (member, data) in enumerate(_members(raw, name)):
        if k >= ARCHIVE_FILES or used >= most:
            break
        if member.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", member) or re.match("[A-Za-z]:", member):
            continue
        if data is None:
            bad = True
            continue
        try:
            got = extract_bytes(data, member, s, depth + 1)
        except Exception:  # noqa: BLE001
            bad = True
            continue
        if got.text:
            section = f"[archive entry: {member}]\n{got.text}"
            parts.append(section)
            used += len(section)
    return Extracted("\n".join(parts)[:most], "archive-partial" if bad else "archive")


def extract_bytes(raw: bytes, name: str, s: Settings, depth: int = 0, path: str | None = None, tools: dict | None = None) -> Extracted:
    """Text of a file by its name's extension. tools: functions for images and media, by family."""
    ext, most = os.path.splitext(name)[1].lower(), (1 << 62) if s.exhaustive else s.max_chars
    if os.path.basename(name).startswith("~$"):
        return Extracted(LOCK_TEXT, "excluded:office-lock")
    if (len(raw) > s.max_bytes and not s.exhaustive) or ext in s.skip_exts:
        return Extracted()
    if ext in TEXT or ext in CODE:
        text = decode(raw[: 4 * most], most, len(raw) > 4 * most)
        return Extracted(strip_tags(text) if s.strip_markup and ext in (".html", ".htm", ".xml") else text, "text")
    if ext in MAIL:
        return Extracted(mail(raw, most), "email")
    if ext in OFFICE:
        return office(raw, *OFFICE[ext], most)
    if ext == ".pdf":
        if path is None:
            raise Unsupported("pdf within an archive")
        if s.exhaustive:
            return pdf_exhaustive(path, s, (tools or {}).get("image"))
        return pdf(path, s, (tools or {}).get("pdf"))
    if ext == ".doc":
        if path is None:
            raise Unsupported("doc within an archive")
        text = run("antiword", path).decode(errors="replace")[:most]
        if not text.strip():
            raise ValueError("no text")
        return Extracted(text, "doc")
    if ext in IMAGE:
        return Extracted() if path is None else image(path, s, (tools or {}).get("image"))
    if ext in MEDIA:
        return Extracted() if path is None else media(path, s, tools or {})
    if ext in ARCHIVE:
        return archive(raw, name, s, depth) if depth < ARCHIVE_DEPTH else Extracted()
    return Extracted(method="excluded:unsupported")


def finish(got: Extracted) -> Extracted:
    """Empty results stay open for another attempt, unless they are terminal."""
    if not got.text.strip() and not got.method.startswith("excluded:") and not got.method.endswith("-partial"):
        got.method += "-partial"
    return got


EXTRACTED = "path string, text string, method string, ocr_used int, pages long, sha1 string, segments array<struct<page:int,text:string>>, elapsed_ms long"


def extract_files(walked: DataFrame, settings: Settings | None = None, tools: dict | None = None) -> DataFrame:
    """One row a path with its text, method and checksum; a failure becomes the method error:<class>.

    Files are read where the task runs, one at a time; a file of very many bytes is hashed in blocks
    and its text is not read beyond the limits.
    """
    s = settings or Settings()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for path in pdf_["path"]:
                began, digest = time.time(), None
                try:
                    size = os.path.getsize(path)
                    sha, head = hashlib.sha1(), io.BytesIO()
                    with open(path, "rb") as f:
                        while block := f.read(1 << 20):
                            sha.update(block)
                            if size <= s.max_bytes or s.exhaustive:
                                head.write(block)
                    digest = sha.hexdigest()
                    big = size > s.max_bytes and not s.exhaustive
                    got = finish(Extracted() if big else extract_bytes(head.getvalue(), os.path.basename(path), s, 0, path, tools))
                except Exception as e:  # noqa: BLE001
                    got = Extracted("", f"error:{failure(e)}")
                rows.append((path, got.text, got.method, got.ocr_used, got.pages, digest, [{"page": k, "text": t} for k, t in got.segments], int((time.time() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["path", "text", "method", "ocr_used", "pages", "sha1", "segments", "elapsed_ms"])

    return walked.select("path").mapInPandas(work, EXTRACTED)


def hash_files(walked: DataFrame) -> DataFrame:
    """(path, sha1) of files read in blocks; null where a file cannot be read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    with open(path, "rb") as f:
                        rows.append((path, hashlib.file_digest(f, "sha1").hexdigest()))
                except OSError:
                    rows.append((path, None))
            yield pd.DataFrame(rows, columns=["path", "sha1"])

    return walked.select("path").mapInPandas(work, "path string, sha1 string")


def revision() -> str:
    """Fingerprint of what this build can extract."""
    known = "|".join(",".join(x) for x in (TEXT, CODE, MAIL, IMAGE, MEDIA, ARCHIVE, tuple(OFFICE)))
    return hashlib.sha1(known.encode()).hexdigest()[:12]
