"""Job-wide settings. They are plain literals captured by the plans, never per-row data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Type groups, limits and defaults every result depends on.
ARCHIVE_EXT = "zip"
JPEG_EXTS = ("jpg", "jpeg")
RASTER_EXTS = ("jpg", "jpeg", "png")
COMPRESSIBLE_EXTS = ("pdf", "jpg", "jpeg", "png")
INPUT_CLEANUP_EXTS = ("pdf", "jpg", "jpeg", "png", "zip")
OUTPUT_CLEANUP_EXTS = ("pdf", "jpg", "jpeg", "png", "csv", "zip")
PNG_LIKE_EXTS = ("png", "bmp", "tiff", "tif", "gif")
UNSUPPORTED_IMAGE_EXTS = ("jbig2", "jpx")
LANGUAGES = ("ja", "en")
FALLBACK_LANGUAGE = "en"
TARGET_DPI = 150
MAX_QUALITY = 100
MAX_DPI = 2400
MAX_EDGE = 65_535
MAX_NESTING = 25
DETAIL_ROWS = 50


@dataclass(frozen=True)
class Quota:
    """Limits above which a whole archive is rejected (all comparisons are strict).

    `max_total_bytes` limits the sum over a file's archive and all archives inside it.
    """

    max_members: int = 10_000
    max_bytes: int = 1_000_000_000
    max_total_bytes: int = 10_000_000_000


@dataclass(frozen=True)
class ResizeSpec:
    """`long_edge` scales the longer side; `manual` uses width and/or height (0 = not given)."""

    mode: str = "manual"
    long_edge: int = 0
    width: int = 0
    height: int = 0
    keep_aspect: bool = True
    allow_upscale: bool = True


@dataclass(frozen=True)
class JobRequest:
    """Everything one reduction job needs to know besides the files themselves."""

    input_dir: str
    output_dir: str
    extract: bool = True
    mirror: bool = False
    repack: bool = False
    audit: bool = True
    audit_path: str | None = None
    language: str = FALLBACK_LANGUAGE
    quota: Quota = field(default_factory=Quota)
    max_nesting: int = MAX_NESTING
    jpeg_quality: int = 75
    png_quality: int = 70
    target_dpi: int = TARGET_DPI
    pdf_engine: str = "native"
    pdf_mode: str = "both"
    pdf_lossless: bool = False
    resize: ResizeSpec | None = None

    @property
    def repack_archives(self) -> bool:
        """Repacking only means something when archives are expanded at all."""
        return self.extract and self.repack
