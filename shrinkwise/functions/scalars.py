"""Scalar column functions: text formats, clamps, geometry, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shrinkwise.config import (
    FALLBACK_LANGUAGE,
    LANGUAGES,
    MAX_DPI,
    MAX_EDGE,
    MAX_QUALITY,
    TARGET_DPI,
    ResizeSpec,
)

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fmt1(x: Column | str) -> Column:
    """`%.1f`, rounding the exact binary value half to even (format_string would round halves up)."""
    return F.call_function("format_number", _col(x).cast("double"), F.lit("0.0"))


def human_readable(n: Column | str) -> Column:
    """Whole bytes in 1024 steps with one decimal: 1280 -> 1.2KB, 1048575 -> 1024.0KB.

    The step is read off the number of binary digits, so `n` is used only a few times.
    """
    n = _col(n).cast("bigint")
    size = F.abs(n)
    step = F.least(F.floor((F.length(F.bin(size)) - 1) / 10), F.lit(len(SIZE_UNITS) - 1)).cast("int") + 1
    divisor = F.element_at(F.array(*[F.lit(float(1024**k)) for k in range(len(SIZE_UNITS))]), step)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), step)
    return F.concat(F.when(n < 0, "-").otherwise(""), fmt1(size / divisor), unit)


def saved_bytes(orig: Column | str, out: Column | str) -> Column:
    return _col(orig) - _col(out)


def saved_pct(orig: Column | str, out: Column | str) -> Column:
    """Negative when the output grew; 0.0 for empty originals."""
    orig, out = _col(orig), _col(out)
    return F.when(orig > 0, (orig - out) / orig * 100).otherwise(0.0)


def size_summary(orig: Column | str, out: Column | str, growth_as_signed: bool = False) -> Column:
    """Before/after text. Growth prints `+5.0%`; `growth_as_signed` keeps the raw `+-5.0%`."""
    orig, out = _col(orig), _col(out)
    saved = saved_bytes(orig, out)
    amount = human_readable(F.abs(saved))
    pct = saved_pct(orig, out)
    grown_pct = pct if growth_as_signed else F.abs(pct)
    delta = (
        F.when(saved > 0, F.concat(F.lit(" (saved: "), amount, F.lit(", -"), fmt1(pct), F.lit("%)")))
        .when(saved < 0, F.concat(F.lit(" (increased: "), amount, F.lit(", +"), fmt1(grown_pct), F.lit("%)")))
        .otherwise(F.lit(" (no change)"))
    )
    return F.concat(F.lit("Before: "), human_readable(orig), F.lit(" -> After: "), human_readable(out), delta)


def _at_least_one(x: Column) -> Column:
    return F.greatest(F.lit(1), x.cast("int"))


def resize_dims(w: Column | str, h: Column | str, spec: ResizeSpec) -> Column:
    """struct<new_w,new_h>; scale first, multiply, truncate, never below one pixel."""
    w, h = _col(w), _col(h)
    same_w, same_h = w.cast("int"), h.cast("int")

    def pair(new_w: Column, new_h: Column) -> Column:
        return F.struct(new_w.cast("int").alias("new_w"), new_h.cast("int").alias("new_h"))

    def scaled(scale: Column) -> tuple[Column, Column]:
        return _at_least_one(w * scale), _at_least_one(h * scale)

    new_w, new_h, enlarges = same_w, same_h, F.lit(False)
    if spec.mode == "long_edge":
        if spec.long_edge > 0:
            scale = F.lit(spec.long_edge) / F.greatest(w, h)
            new_w, new_h = scaled(scale)
            enlarges = scale > 1
    elif spec.width > 0 or spec.height > 0:
        by_w, by_h = F.lit(spec.width) / w, F.lit(spec.height) / h
        if not spec.keep_aspect:
            new_w = F.lit(spec.width) if spec.width > 0 else same_w
            new_h = F.lit(spec.height) if spec.height > 0 else same_h
            enlarges = (new_w > same_w) | (new_h > same_h)
        elif spec.width > 0 and spec.height > 0:
            new_w, new_h = scaled(F.least(by_w, by_h))
            enlarges = F.least(by_w, by_h) > 1
        elif spec.width > 0:
            new_w, new_h = F.lit(spec.width), _at_least_one(h * by_w)
            enlarges = by_w > 1
        else:
            new_w, new_h = _at_least_one(w * by_h), F.lit(spec.height)
            enlarges = by_h > 1
    dims = pair(new_w, new_h)
    if not spec.allow_upscale:
        dims = F.when(enlarges, pair(same_w, same_h)).otherwise(dims)
    return F.when((w > 0) & (h > 0), dims)


def effective_dpi(w: Column | str, h: Column | str, rect_w: Column | str, rect_h: Column | str) -> Column:
    """Pixels per inch of a placement measured in points; null for an empty rectangle."""
    w, h, rect_w, rect_h = _col(w), _col(h), _col(rect_w), _col(rect_h)
    return F.when(
        (rect_w > 0) & (rect_h > 0), F.greatest(w / (rect_w / 72.0), h / (rect_h / 72.0))
    )


def dpi_dims(w: Column | str, h: Column | str, dpi: Column | str, target_dpi: int = TARGET_DPI) -> Column:
    """struct<resized,new_w,new_h>: only images above the target are scaled down."""
    w, h, dpi = _col(w), _col(h), _col(dpi)
    above = dpi > target_dpi
    scale = F.lit(target_dpi) / dpi
    return F.struct(
        above.alias("resized"),
        F.when(above, _at_least_one(w * scale)).otherwise(w.cast("int")).alias("new_w"),
        F.when(above, _at_least_one(h * scale)).otherwise(h.cast("int")).alias("new_h"),
    )


# Number texts as a scripting language reads them: surrounding blanks, sign, digit groups with '_'.
INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT_TEXT = (
    r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)


def _stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _parse_int(x: Column, is_text: bool, top: int) -> Column:
    """Whole number limited to -1..top+1, null when it cannot be read."""
    if not is_text:
        number = x.cast("double")
        readable = ~F.isnan(number) & (F.abs(number) != float("inf"))
        return F.when(readable, F.least(F.greatest(number, F.lit(-1.0)), F.lit(top + 1.0)).cast("bigint"))
    text = _stripped(x)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    value = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(top + 1).cast("decimal(38,0)"))
    limited = F.least(value, F.lit(top + 1).cast("decimal(38,0)")).cast("bigint")
    return F.when(text.rlike(INT_TEXT), F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(limited))


def clamp_quality(x: Column | str, default: int = MAX_QUALITY, is_text: bool = True) -> Column:
    """0..100; text that is not a whole number ('3.8', 'abc', null) gives the default."""
    parsed = F.coalesce(_parse_int(_col(x), is_text, MAX_QUALITY), F.lit(default))
    return F.greatest(F.lit(0), F.least(F.lit(MAX_QUALITY), parsed)).cast("int")


def quality_range(quality: Column) -> Column:
    """struct<low,high> handed to a quantiser: twenty below the (clamped) upper bound."""
    return F.struct(F.greatest(F.lit(0), quality - 20).cast("int").alias("low"), quality.cast("int").alias("high"))


def clamp_speed(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(11), _col(x).cast("int")))


def clamp_dpi(x: Column | str, lo: int = 1, hi: int = MAX_DPI, is_text: bool = True) -> Column:
    """lo..hi, null when absent or unreadable."""
    parsed = _parse_int(_col(x), is_text, hi)
    return F.when(parsed.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), parsed))).cast("int")


def mono_dpi(dpi: Column) -> Column:
    """One-bit images are kept at twice the resolution."""
    return dpi * 2


def to_non_negative_int(s: Column | str, cap: int | None = MAX_EDGE) -> Column:
    """Form text to a whole number: truncates decimals, 0 for negatives and anything unreadable."""
    text = _stripped(_col(s))
    number = F.when(text.rlike(FLOAT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    usable = (number >= 0) & (number != float("inf"))
    top = float(cap) if cap is not None else float(2**62)
    return F.coalesce(F.when(usable, F.least(number, F.lit(top)).cast("bigint")), F.lit(0).cast("bigint"))


def normalize_language(s: Column | str) -> Column:
    """'ja_JP', ' EN-us ' -> ja, en; anything unknown or empty -> en."""
    first = F.lower(F.split(F.replace(_stripped(_col(s)), F.lit("-"), F.lit("_")), "_")[0])
    return F.when(first.isin(*LANGUAGES), first).otherwise(F.lit(FALLBACK_LANGUAGE))


def fill_template(template: Column | str, **values: Column) -> Column:
    """Replace `{name}` by the named columns in one pass; the raw template if anything is missing.

    `{{` and `}}` stand for single braces. `{name:.1f}` formats a number with one decimal; texts, and
    numbers with other formats, are inserted as they are.
    """
    template = _col(template)
    # Doubled braces step aside, as characters that templates do not hold, while single ones are read.
    # Of an odd number of closing braces the first one closes a placeholder.
    hidden = F.regexp_replace(F.replace(template, F.lit("{{"), F.lit("\x01")), r"\}\}(?=(\}\})*([^}]|$))", "\x02")
    placeholder = r"\{([A-Za-z_][A-Za-z0-9_]*)((?:[:!][^{}]*)?)\}"
    names = F.regexp_extract_all(hidden, F.lit(placeholder), F.lit(1))
    formats = F.regexp_extract_all(hidden, F.lit(placeholder), F.lit(2))
    texts = F.split(hidden, placeholder, -1)

    def shown(value: Column, decimal: bool) -> Column:
        text = F.coalesce(value.cast("string"), F.lit("None"))
        number = F.when(F.typeof(value) != "string", value.cast("string").try_cast("double"))
        return F.coalesce(fmt1(number), text) if decimal else text

    def table(decimal: bool) -> Column:
        pairs = [item for key, value in values.items() for item in (F.lit(key), shown(value, decimal))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    plain, decimals = table(False), table(True)
    inserted = F.zip_with(names, formats, lambda name, form: F.when(form == ":.1f", decimals[name]).otherwise(plain[name]))
    filled = F.zip_with(texts, inserted, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
    unknown = F.exists(names, lambda name: ~F.map_contains_key(plain, name)) if values else F.size(names) > 0
    malformed = F.exists(texts, lambda text: text.rlike(r"[{}]"))
    joined = F.translate(F.array_join(filled, ""), "\x01\x02", "{}")
    return F.when(F.coalesce(unknown | malformed, F.lit(False)), template).otherwise(joined)


def clean_error(message: Column | str, *paths: Column, limit: int = 240) -> Column:
    """One line, full paths cut to their file names, limited length."""
    text = F.trim(F.regexp_replace(F.coalesce(_col(message), F.lit("")), r"(?U)\s+", " "))
    for path in paths:
        name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
        text = F.when(F.coalesce(path, F.lit("")) != "", F.replace(text, path, name)).otherwise(text)
    return F.substring(text, 1, limit)


def has_transparency(
    has_alpha_band: Column, alpha_min: Column, palette_alpha: Column | None = None, other_marker: Column | None = None
) -> Column:
    """Effective transparency: alpha band, then palette transparency values, then any other marker."""
    result = F.when(has_alpha_band, F.coalesce(alpha_min < 255, F.lit(True)))
    if palette_alpha is not None:
        result = result.when(palette_alpha.isNotNull(), F.exists(palette_alpha, lambda v: v < 255))
    if other_marker is not None:
        result = result.when(other_marker.isNotNull(), F.lit(True))
    return result.otherwise(F.lit(False))


def tool_label(tool: Column | str, source_text: Column) -> Column:
    """`pngquant(<where it came from>)`; other quantisers by their plain name."""
    tool = _col(tool)
    return F.when(tool == "pngquant", F.concat(tool, F.lit("("), source_text, F.lit(")"))).otherwise(tool)


def iso_ts(ts: Column | str) -> Column:
    """ISO time; the fraction appears only when it is not zero."""
    return F.regexp_replace(F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def file_stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")
