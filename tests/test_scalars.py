import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shrinkwise.config import ResizeSpec
from shrinkwise.functions import scalars


def column_values(spark, rows, schema, column):
    """Evaluate one column over rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos int, {schema}")
    return [r[0] for r in df.orderBy("pos").select(column).collect()]


SIZES = {
    0: "0.0B", 1: "1.0B", 1023: "1023.0B", 1024: "1.0KB", 1280: "1.2KB", 1331: "1.3KB", 1536: "1.5KB", 1048575: "1024.0KB", 1048576: "1.0MB",
    5_242_880: "5.0MB", 1_073_741_824: "1.0GB", 1_610_612_736: "1.5GB", 1_099_511_627_776: "1.0TB", 1_125_899_906_842_624: "1.0PB",
    2_305_843_009_213_693_952: "2048.0PB", -5: "-5.0B", -1280: "-1.2KB", -1_048_576: "-1.0MB",
}


def test_human_readable_sizes(spark):
    got = column_values(spark, [(s,) for s in SIZES], "n bigint", scalars.human_readable("n"))
    assert got == list(SIZES.values())


def test_human_readable_tells_the_size_to_a_tenth_of_its_unit(spark):
    rng = random.Random(3)
    sizes = [rng.randint(0, 2 ** rng.randint(1, 49)) for _ in range(1000)]
    units = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}
    for size, text in zip(sizes, column_values(spark, [(s,) for s in sizes], "n bigint", scalars.human_readable("n")), strict=True):
        number, unit = float(text.rstrip("BKMGT")), text.lstrip("-.0123456789")
        assert abs(number * 1024 ** units[unit] - size) <= 0.0501 * 1024 ** units[unit] and number <= 1024


def test_fmt1_rounds_the_binary_value_half_even(spark):
    values = [(a - b) / a * 100 for a in range(1, 90) for b in range(0, 180, 7)] + [0.25, 0.35, 0.05, -0.04, 1e12]
    got = column_values(spark, [(v,) for v in values], "x double", scalars.fmt1("x"))
    assert got == [f"{v:.1f}" for v in values]


def test_size_summary_texts(spark):
    rows = [(2048, 1024), (1000, 1050), (10, 10), (0, 5)]
    got = column_values(spark, rows, "o bigint, n bigint", scalars.size_summary("o", "n"))
    assert got == [
        "Before: 2.0KB -> After: 1.0KB (saved: 1.0KB, -50.0%)",
        "Before: 1000.0B -> After: 1.0KB (increased: 50.0B, +5.0%)",
        "Before: 10.0B -> After: 10.0B (no change)",
        "Before: 0.0B -> After: 5.0B (increased: 5.0B, +0.0%)",
    ]
    raw = column_values(spark, rows, "o bigint, n bigint", scalars.size_summary("o", "n", growth_as_signed=True))
    assert raw[1].endswith("+-5.0%)")


RESIZED = [
    (ResizeSpec("long_edge", long_edge=500), {(2000, 1000): (500, 250), (1, 1): (500, 500), (1, 5000): (1, 500), (300, 400): (375, 500)}),
    (ResizeSpec("long_edge", long_edge=0), {(2000, 1000): (2000, 1000), (7, 9): (7, 9)}),
    (ResizeSpec(width=640, height=480), {(1280, 960): (640, 480), (2000, 1000): (640, 320), (1000, 2000): (240, 480)}),
    (ResizeSpec(width=300), {(600, 200): (300, 100), (1000, 3): (300, 1), (150, 60): (300, 120)}),
    (ResizeSpec(height=200), {(600, 400): (300, 200), (3, 1000): (1, 200), (50, 100): (100, 200)}),
    (ResizeSpec(width=300, keep_aspect=False), {(600, 200): (300, 200), (10, 10): (300, 10)}),
    (ResizeSpec(width=300, height=7, keep_aspect=False), {(600, 200): (300, 7), (1, 1): (300, 7)}),
    (ResizeSpec(), {(600, 200): (600, 200)}),
]


@pytest.mark.parametrize(("spec", "cases"), RESIZED)
def test_resize_geometry(spark, spec, cases):
    got = column_values(spark, list(cases), "w int, h int", scalars.resize_dims("w", "h", spec))
    assert [tuple(g) for g in got] == list(cases.values())


def test_resizing_keeps_the_ratio_and_hits_the_long_edge(spark):
    rng = random.Random(5)
    dims = [(rng.randint(1, 9000), rng.randint(1, 9000)) for _ in range(400)]
    got = column_values(spark, dims, "w int, h int", scalars.resize_dims("w", "h", ResizeSpec("long_edge", long_edge=720)))
    for (w, h), (new_w, new_h) in zip(dims, got, strict=True):
        assert 719 <= max(new_w, new_h) <= 720 and min(new_w, new_h) >= 1
        assert abs(new_w - w * 720 / max(w, h)) <= 1 and abs(new_h - h * 720 / max(w, h)) <= 1


def test_resize_can_refuse_to_enlarge(spark):
    spec = ResizeSpec("long_edge", long_edge=400, allow_upscale=False)
    got = column_values(spark, [(100, 50), (800, 400), (-1, 5)], "w int, h int", scalars.resize_dims("w", "h", spec))
    assert [tuple(g) if g else None for g in got] == [(100, 50), (400, 200), None]


def test_dpi_plan(spark):
    rows = [(2400, 1200, 144.0, 72.0), (10, 10, 720.0, 720.0), (3, 7, 0.01, 5.0)]
    dpi = scalars.effective_dpi("w", "h", "rw", "rh")
    schema = "w int, h int, rw double, rh double"
    expected_dpi = [max(w / (rw / 72.0), h / (rh / 72.0)) for w, h, rw, rh in rows]
    assert column_values(spark, rows, schema, dpi) == expected_dpi
    dims = column_values(spark, rows, schema, scalars.dpi_dims("w", "h", dpi, 72))
    assert [tuple(d) for d in dims] == [(True, 144, 72), (False, 10, 10), (True, 1, 1)]


NUMBER_TEXTS = [
    "42", "-4", "3.8", "abc", " 5 ", "1e3", "inf", "nan", "", "0x10", "-0.5", "1_000", "5d", "999999", "+7", "1__0",
    "_1", ".5", "5.", ".", "1e400", "9" * 45, "-" + "9" * 45, "1e-3", None, "12\t", "-0", "1_0.5_0",
]


#: What each of those texts is as a form's whole number of at most 65535, worked out by hand.
WHOLE_NUMBERS = [
    42, 0, 3, 0, 5, 1000, 0, 0, 0, 0, 0, 1000, 0, 65535, 7, 0,
    0, 0, 5, 0, 0, 65535, 0, 0, 0, 12, 0, 10,
]


def plain_int(text):
    try:
        return int(text)
    except Exception:
        return None


def test_form_numbers(spark):
    got = column_values(spark, [(t,) for t in NUMBER_TEXTS], "s string", scalars.to_non_negative_int("s", 65535))
    assert got == WHOLE_NUMBERS
    assert column_values(spark, [("999999",)], "s string", scalars.to_non_negative_int("s", 100)) == [100]


def test_clamps(spark):
    rows = [(t,) for t in NUMBER_TEXTS]
    wholes = [plain_int(t) for t in NUMBER_TEXTS]
    quality = column_values(spark, rows, "s string", scalars.clamp_quality("s", 70))
    assert quality == [max(0, min(100, 70 if n is None else n)) for n in wholes]
    dpi = column_values(spark, rows, "s string", scalars.clamp_dpi("s"))
    assert dpi == [None if n is None else max(1, min(2400, n)) for n in wholes]
    form = column_values(spark, rows, "s string", scalars.clamp_dpi("s", 36, 600))
    assert form == [None if n is None else max(36, min(600, n)) for n in wholes]


def test_numeric_clamps_and_ranges(spark):
    rows = [(3.8,), (-2.0,), (250.0,), (math.nan,), (math.inf,), (None,)]
    assert column_values(spark, rows, "x double", scalars.clamp_quality("x", 75, is_text=False)) == [3, 0, 100, 75, 75, 75]
    ranges = column_values(spark, [(5,), (80,)], "q int", scalars.quality_range(F.col("q")))
    assert [tuple(r) for r in ranges] == [(0, 5), (60, 80)]
    assert column_values(spark, [(0,), (3,), (99,)], "x int", scalars.clamp_speed("x")) == [1, 3, 11]


def test_language(spark):
    texts = ["ja", "ja_JP", " EN-us ", "fr", "", None, "JA", "en_GB_x", "-ja"]
    assert column_values(spark, [(t,) for t in texts], "s string", scalars.normalize_language("s")) == [
        "ja", "ja", "en", "en", "en", "en", "ja", "en", "en",
    ]


def test_template(spark):
    rows = [("{name} is {size}",), ("{name} {other}",), ("{name} {",), ("none",), ("{size:.1f}%{name}",), ("{0}",), (None,)]
    filled = scalars.fill_template("t", name=F.lit("{size}"), size=F.lit(3))
    assert column_values(spark, rows, "t string", filled) == [
        "{size} is 3", "{name} {other}", "{name} {", "none", "3.0%{size}", "{0}", None,
    ]
    rows = [("{{name}} {size}",), ("{{{size}}}",), ("}} {{",), ("{{name}",)]
    assert column_values(spark, rows, "t string", filled) == ["{name} 3", "{3}", "} {", "{{name}"]
    texts = scalars.fill_template("t", saved=F.lit("about 5"), pct=F.lit(2.25))
    assert column_values(spark, [("{saved:.1f} {pct:.1f}",)], "t string", texts) == ["about 5 2.2"]


def test_error_cleanup(spark):
    rows = [("  bad\n\tfile /tmp/a/in.pdf  -> /tmp/a/out.pdf ",), (None,), ("x" * 500,)]
    got = column_values(spark, rows, "m string", scalars.clean_error("m", F.lit("/tmp/a/in.pdf"), F.lit("/tmp/a/out.pdf")))
    assert got == ["bad file in.pdf -> out.pdf", "", "x" * 240]


def test_transparency(spark):
    rows = [
        (True, 254, None, None), (True, 255, [0], None), (True, None, None, None),
        (False, None, [255, 255], "x"), (False, None, [255, 3], None), (False, None, None, "key"), (False, 0, None, None),
    ]
    column = scalars.has_transparency(F.col("band"), F.col("low"), F.col("palette"), F.col("marker"))
    got = column_values(spark, rows, "band boolean, low int, palette array<int>, marker string", column)
    assert got == [True, False, True, False, True, True, False]


def test_tool_label_and_stamps(spark):
    rows = [("pngquant",), ("palette",)]
    assert column_values(spark, rows, "t string", scalars.tool_label("t", F.lit("system"))) == ["pngquant(system)", "palette"]
    times = [datetime(2024, 5, 6, 7, 8, 9, 120000), datetime(2024, 5, 6, 7, 8, 9)]
    rows = [(t,) for t in times]
    assert column_values(spark, rows, "t timestamp_ntz", scalars.iso_ts("t")) == [t.isoformat() for t in times]
    assert column_values(spark, rows, "t timestamp_ntz", scalars.file_stamp("t")) == ["20240506_070809"] * 2
