"""Settings: built-in values, a config file over them, a request over both, all validated."""

from __future__ import annotations

import math
import os
import sys
from dataclasses import dataclass, field, fields, replace

# Ranges of numbers, and choices.
RANGES = {
    "workers": (1, 64), "embed_workers": (1, 8), "commit_batch": (1, 1_000_000), "ocr_max_pages": (1, 500), "ocr_dpi": (150, 1200), "ocr_psm": (0, 13), "detector_confidence": (0.05, 0.95),
    "tag_score": (0.0, 1.0), "tag_top_k": (1, 32), "face_score": (0.05, 0.99), "max_faces": (1, 200), "max_frames": (1, 64), "vision_timeout": (5, 1800), "caption_timeout": (5, 1800), "headroom": (0, 50),
}
CHOICES = {"ocr": ("auto", "on", "off", "exhaustive"), "sidecar": ("mirror", "inplace", "none"), "vision": ("off", "meta", "tags", "captions")}
SKIP_DIRS = ("$RECYCLE.BIN", "System Volume Information", ".git", "$WinREAgent", "Windows", "node_modules", "index_out", ".venv", "venv", "site-packages", "__pycache__")
SKIP_PATHS_WINDOWS = (
    r"?:\Windows", r"?:\Program Files", r"?:\Program Files (x86)", r"?:\ProgramData", r"?:\Users\*\AppData", r"?:\$WinREAgent", r"?:\Recovery", r"?:\PerfLogs", r"?:\System Volume Information", r"?:\$Recycle.Bin",
)
SKIP_PATHS_LINUX = ("/proc", "/sys", "/dev", "/run", "/snap", "/var/lib/docker", "/var/lib/containers", "/lost+found")
SKIP_PATHS = {"win32": SKIP_PATHS_WINDOWS, "linux": SKIP_PATHS_LINUX}.get(sys.platform, ())
SKIP_EXTS = (".sys", ".dll", ".exe", ".iso", ".vmdk", ".lock")


@dataclass(frozen=True)
class Settings:
    ocr: str = "auto"
    sidecar: str = "mirror"
    vision: str = "off"
    workers: int = 8
    embed_workers: int = 2
    commit_batch: int = 100
    max_bytes: int = 100 << 20
    max_chars: int = 1_000_000
    ocr_max_pages: int = 20
    ocr_dpi: int = 300
    ocr_psm: int = 3
    detector_confidence: float = 0.5
    tag_score: float = 0.22
    tag_top_k: int = 8
    face_score: float = 0.9
    max_faces: int = 20
    max_frames: int = 12
    vision_timeout: int = 60
    caption_timeout: int = 300
    headroom: int = 0
    follow_symlinks: bool = False
    strip_markup: bool = False
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    skip_paths: tuple[str, ...] = SKIP_PATHS
    skip_exts: tuple[str, ...] = SKIP_EXTS
    lexicons: str | None = None
    hash_backfill: bool = True
    retry_errors: bool = False
    faces_model: str | None = None

    @property
    def exhaustive(self) -> bool:
        return self.ocr == "exhaustive"

    def cores(self, available: int) -> int:
        return max(1, available * (100 - self.headroom) // 100)


class InvalidSetting(ValueError):
    """A setting that is unknown, of another type, or out of its range."""


def checked(values: dict) -> dict:
    """All names, types and ranges are checked before anything is applied."""
    kinds = {f.name: f.default for f in fields(Settings)}
    out = {}
    for name, value in values.items():
        if name not in kinds:
            raise InvalidSetting(f"unknown setting {name}")
        default = kinds[name]
        if isinstance(default, tuple):
            if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                raise InvalidSetting(f"{name} is a list of strings")
            value = tuple(value)
        elif isinstance(default, bool) != isinstance(value, bool) or (default is None and not isinstance(value, (str, type(None)))) or (default is not None and not isinstance(value, (int, float) if isinstance(default, float) else type(default))):
            raise InvalidSetting(f"{name} is of another type")
        if name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
            raise InvalidSetting(f"{name} is not within {RANGES[name][0]}..{RANGES[name][1]}")
        if name in CHOICES and value not in CHOICES[name]:
            raise InvalidSetting(f"{name} is none of {', '.join(CHOICES[name])}")
        out[name] = value
    return out


def load(path: str | None) -> dict:
    """Values of a YAML (or JSON) file; numbers beyond their range are moved to its end, other mistakes raise.

    No path gives no values. A relative folder of lexicons is taken from the file's own folder.
    """
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        import yaml

        found = yaml.safe_load(body)
    except ImportError:  # JSON is YAML too
        import json

        found = json.loads(body or "{}")
    except yaml.YAMLError as e:
        raise InvalidSetting(f"{path} cannot be read: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise InvalidSetting(f"{path} holds no settings")
    for name, (least, most) in RANGES.items():
        value = found.get(name)
        if isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value):
            found[name] = type(value)(min(max(value, least), most))
    if isinstance(found.get("lexicons"), str):
        found["lexicons"] = os.path.join(os.path.dirname(os.path.abspath(path)), found["lexicons"])
    return checked(found)


def include_paths(roots: list[str], wanted: list[str] | None) -> list[str] | None:
    """Real paths of files named relative to a root, which must exist below one of the roots."""
    if wanted is None:
        return None
    roots, out = [os.path.realpath(r) for r in roots], []
    for w in wanted:
        parts = w.replace("\\", "/").split("/")
        if os.path.isabs(w) or ".." in parts or (len(w) > 1 and w[1] == ":"):
            raise InvalidSetting(f"{w} is not relative to a root")
        real = [os.path.realpath(os.path.join(r, w)) for r in roots]
        fit = [p for p in real if os.path.isfile(p) and any(p == r or p.startswith(r.rstrip("/") + "/") for r in roots)]
        if not fit:
            raise InvalidSetting(f"{w} is no file below the roots")
        out.append(fit[0])
    return out


def corpus_name(name: str) -> str:
    """A corpus is named by a plain folder name; anything that could leave the folder of corpora raises."""
    if not name or name in (".", "..", "jobs") or name.startswith(".") or any(c in name for c in "/\\:\0"):
        raise InvalidSetting(f"{name!r} is no name of a corpus")
    return name


def merged(config: dict | None = None, request: dict | None = None) -> Settings:
    """A request's values win over the config's, and these over the built-in ones."""
    return replace(Settings(), **checked(config or {}) | checked(request or {}))


@dataclass
class Runtime:
    """Stage sizes that may be changed while jobs run; a bad request changes nothing."""

    stages: dict[str, int] = field(default_factory=lambda: {"extract": 8, "embed": 2, "ocr": 8})
    LIMITS = {"extract": (1, 64), "embed": (1, 8), "ocr": (1, 64)}

    def apply(self, request: dict) -> dict[str, int]:
        for name, value in request.items():
            if name not in self.LIMITS or isinstance(value, bool) or not isinstance(value, int):
                raise InvalidSetting(f"{name}={value!r}")
        self.stages |= {n: min(max(v, self.LIMITS[n][0]), self.LIMITS[n][1]) for n, v in request.items()}
        return dict(self.stages)
