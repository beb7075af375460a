"""Path expressions. All paths use '/' and every expression stays in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.config import ARCHIVE_EXT


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path: Column | str) -> Column:
    """Everything before the last '/', or '' when there is none."""
    path = _col(path)
    below = F.length(path) - F.length(base_name(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(below, F.lit(0)))


def _suffix(name: Column) -> Column:
    """Text after the last dot of a file name: '.jpg' and 'a.' have none, '..jpg' does.

    Plain string functions, which measured faster than a regular expression here.
    """
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(name) > F.length(tail) + 1, tail).otherwise("")


def file_extension(path: Column | str) -> Column:
    """Lower-case suffix without the dot, '' when there is none."""
    return F.lower(_suffix(base_name(path)))


def without_suffix(path: Column | str) -> Column:
    """The path without its last suffix: parent folder and stem."""
    path = _col(path)
    suffix = F.length(_suffix(base_name(path)))
    return F.substring(path, F.lit(1), F.length(path) - F.when(suffix > 0, suffix + 1).otherwise(0))


def stem(path: Column | str) -> Column:
    return without_suffix(base_name(path))


def relative_path(path: Column | str, base: Column | str) -> Column:
    """Path below `base`; '.' for the base itself; the bare file name for anything elsewhere.

    `base` given as text is a literal folder, given as a Column it is read per row.
    """
    path = _col(path)
    base = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    prefix = F.concat(base, F.lit("/"))
    return (
        F.when(path == base, F.lit("."))
        .when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))
        .otherwise(base_name(path))
    )


def normalize_path(path: Column | str) -> Column:
    """Resolve '.', '..' and doubled slashes as text; keeps a leading '/'."""
    path = _col(path)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(resolved, "/"))


def paths_overlap(a: Column | str, b: Column | str) -> Column:
    """Equal, or one contains the other; an empty path never overlaps."""
    a, b = _col(a), _col(b)
    na, nb = normalize_path(a), normalize_path(b)

    def below(inner: Column, outer: Column) -> Column:
        return F.startswith(inner, F.concat(F.rtrim(outer, F.lit("/")), F.lit("/")))

    return F.coalesce((a != "") & (b != "") & ((na == nb) | below(na, nb) | below(nb, na)), F.lit(False))


def overlapping_roots(df: DataFrame, a: str = "input_root", b: str = "output_root") -> DataFrame:
    """Rows whose two roots must not be used together."""
    return df.where(paths_overlap(a, b))


def archive_plan(df: DataFrame, path: str = "archive_path", output_base: str = "") -> DataFrame:
    """Where an archive's contents and its regenerated file go, relative to `output_base`."""
    folder = without_suffix(path)
    if output_base:
        folder = F.concat(F.lit(f"{output_base.rstrip('/')}/"), folder)
    return df.withColumns(
        {
            "folder_output_root": folder,
            "archive_output_path": F.concat(folder, F.lit(f".{ARCHIVE_EXT}")),
        }
    )


def audit_paths(
    df: DataFrame, repack: bool = False, archive: str = "archive_path", inner: str = "rel_path"
) -> DataFrame:
    """Audit columns of an archive member: `zip::inner`, its output path, and the repack note."""
    folder = without_suffix(archive)
    note = F.concat(F.lit("zip_archive="), folder, F.lit(f".{ARCHIVE_EXT}"))
    return df.withColumns(
        {
            "audit_input": F.concat_ws("::", F.col(archive), F.col(inner)),
            "audit_output": F.concat_ws("/", folder, F.col(inner)),
            "notes": note if repack else F.lit(""),
        }
    )


def ancestor_dirs(path: Column | str) -> Column:
    """All folders above a relative file path, outermost first."""
    parts = F.split(_col(path), "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    dirs = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, dirs).otherwise(F.array().cast("array<string>"))
