"""Files, archives, repository addresses and history as DataFrames."""

from __future__ import annotations

import io
import re
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Repository address format and clone failure signs, first match wins.
REPOSITORY_PATTERN = r"^(https://github\.com/|git@github\.com:)([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(\.git)?/?$"
CLONE_FAILURES = [
    (("authentication", "access denied"), "REPO_ACCESS_DENIED"),
    (("could not resolve host", "failed to connect"), "NETWORK_ERROR"),
    (("repository not found",), "REPO_NOT_FOUND"),
]
CLONE_OTHER = "GIT_CLONE_FAILED"


def clean_bytes(data: Column, max_bytes: int | None = None) -> Column:
    """A file as text; bytes that are no UTF-8 are dropped. ``max_bytes`` cuts it, if given."""
    head = data if max_bytes is None else F.substring(data, 1, max_bytes)
    repaired = F.replace(F.make_valid_utf8(head), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(head), head.cast("string")).otherwise(repaired)


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``; either may carry a scheme and an authority."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    inner = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    return F.regexp_replace(unified, r"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?/*\Q" + inner + r"\E/+", "")


def _fits(path: Column, include_extensions=None, exclude_paths=None) -> Column:
    """Known suffix and no excluded part."""
    fits = text.suffix(path).isin(text.normalized_extensions(include_extensions or dims.DEFAULT_EXTENSIONS))
    for token in exclude_paths or []:
        if token.strip():
            fits = fits & ~F.lower(path).contains(token.lower().strip())
    return fits


def read_files(spark: SparkSession, root: str, include_extensions=None, exclude_paths=None, max_bytes: int | None = None) -> DataFrame:
    """Every file below ``root/<scan_id>/`` as ``files(scan_id, file_path, content)``, on any file system.

    With suffixes or excluded parts only the files that pass are opened: the test is on the path that the
    listing knows, so that it prunes files before any content is read. ``max_bytes`` cuts contents and adds
    ``truncated``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if include_extensions or exclude_paths:
        listed = F.regexp_replace(relative_path(F.col("_metadata.file_path"), root), "^[^/]*/", "")
        raw = raw.where(_fits(listed, include_extensions, exclude_paths))
    local = relative_path(F.col("path"), root)
    cut = [] if max_bytes is None else [(F.col("length") > max_bytes).alias("truncated")]
    return raw.select(
        F.substring_index(local, "/", 1).alias("scan_id"),
        F.regexp_replace(local, "^[^/]*/", "").alias("file_path"),
        clean_bytes(F.col("content"), max_bytes).alias("content"), *cut,
    )


def mark_source_files(
    files: DataFrame, include_extensions=None, exclude_paths=None, max_files: int | None = None
) -> DataFrame:
    """Adds ``selected``: known suffix, no excluded path part, and if given among the first ``max_files`` by path.

    The cap works on paths alone. Each task keeps at most ``max_files`` paths of a scan before the
    shuffle, and what comes back is one last path per scan that reaches the cap; the contents are
    tested against it and take no part in a shuffle while that table is small.
    """
    fits = _fits(F.col("file_path"), include_extensions, exclude_paths)
    if not max_files:
        return files.withColumn("selected", fits)
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    session = files.sparkSession
    if int(session.conf.get(limit)) < max_files:
        session.conf.set(limit, str(max_files))  # else each scan's paths are sorted in one task
    order = Window.partitionBy("scan_id").orderBy("file_path")
    last = (
        files.where(fits).select("scan_id", "file_path")
        .withColumn("file_rank", F.row_number().over(order))
        .where(F.col("file_rank") == max_files)
        .select("scan_id", F.col("file_path").alias("last_path"))
    )
    bounded = files.join(last, "scan_id", "left")
    in_cap = F.col("last_path").isNull() | (F.col("file_path") <= F.col("last_path"))
    return bounded.select(*files.columns, (fits & in_cap).alias("selected"))


def skipped_files(marked: DataFrame) -> DataFrame:
    """``(scan_id, file_path, reason)`` of the files that ``mark_source_files`` left out."""
    return marked.where(~F.coalesce("selected", F.lit(False))).select("scan_id", "file_path", F.lit("NOT_SELECTED").alias("reason"))


def select_source_files(files: DataFrame, include_extensions=None, exclude_paths=None, max_files: int | None = None) -> DataFrame:
    """The files a scan looks at, see `mark_source_files`."""
    return mark_source_files(files, include_extensions, exclude_paths, max_files).where("selected").select(*files.columns)


def manifests(files: DataFrame) -> DataFrame:
    path = F.lower("file_path")
    kind = F.when(path.endswith("requirements.txt"), "requirements").when(path.endswith("package.json"), "package")
    return files.withColumn("manifest_kind", kind).where(F.col("manifest_kind").isNotNull())


def archive_verdict(name: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Null for an archive that may be opened, else the reason against it."""
    verdict = F.when(~F.lower(name).endswith(".zip"), "NOT_A_ZIP_NAME")
    return verdict if max_bytes is None else verdict.when(size > max_bytes, "TOO_LARGE")


ARCHIVE_SCHEMA = "path string, member string, data binary, error string"


def _escapes(member: str) -> bool:
    depth = 0
    for part in member.split("/"):
        depth += 0 if part in ("", ".") else -1 if part == ".." else 1
        if depth < 0:
            return True
    return member.startswith("/")


def _open_archive(path: str, payload: bytes, max_total: int | None, max_member: int | None):
    """(path, member, bytes, error) of one archive; an unsafe one gives a single error row, as does each member over its limit."""
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as archive:
            members = archive.infolist()
            names = [m.filename.replace("\\", "/") for m in members]
            if max_total is not None and sum(m.file_size for m in members) > max_total:
                return [(path, None, None, "EXTRACTED_SIZE_TOO_LARGE")]
            if any(_escapes(n) for n in names if not n.endswith("/")):
                return [(path, None, None, "UNSAFE_MEMBER_PATH")]
            wanted = [(name, m, max_member is None or m.file_size <= max_member) for name, m in zip(names, members) if not name.endswith("/")]
            return [(path, name, archive.read(m) if fits else None, None if fits else "MEMBER_TOO_LARGE") for name, m, fits in wanted]
    except Exception as error:  # noqa: BLE001 - a damaged archive is a row, not a failed job
        reason = "NOT_A_ZIP_FILE" if isinstance(error, zipfile.BadZipFile) else "UNREADABLE_ARCHIVE"
        return [(path, None, None, reason)]


def archive_members(
    archives: DataFrame, max_total: int | None = None, max_member: int | None = None, max_archive: int | None = None
) -> DataFrame:
    """Members of ``archives(path, length, content)``; refused archives and members carry an error.

    The tests of name and length are plain filters, so that a file source does not read what they refuse.
    """
    fits = F.lower("path").endswith(".zip")
    if max_archive is not None:
        fits = fits & (F.col("length") <= max_archive)
    verdict = archive_verdict(F.col("path"), F.col("length"), max_archive)
    nothing = [F.lit(None).cast("string").alias("member"), F.lit(None).cast("binary").alias("data")]
    refused = archives.where(~fits).select("path", *nothing, verdict.alias("error"))

    def unpack(batches):
        for batch in batches:
            for path, payload in zip(batch["path"], batch["content"]):
                rows = _open_archive(path, payload, max_total, max_member)
                yield pd.DataFrame(rows, columns=["path", "member", "data", "error"])

    opened = archives.where(fits).select("path", "content").mapInPandas(unpack, ARCHIVE_SCHEMA)
    return opened.unionByName(refused)


def archive_files(members: DataFrame) -> DataFrame:
    """``files`` from unpacked members; the archive name without suffix is the scan."""
    scan = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.zip$", "")
    return members.where(F.col("error").isNull()).select(
        scan.alias("scan_id"), F.col("member").alias("file_path"), clean_bytes(F.col("data")).alias("content")
    )


def repository(url: Column) -> dict[str, Column]:
    trimmed = text.strip(url)
    return {
        "valid": F.coalesce(trimmed.rlike(REPOSITORY_PATTERN), F.lit(False)),
        "owner": F.regexp_extract(trimmed, REPOSITORY_PATTERN, 2),
        "repo": F.regexp_extract(trimmed, REPOSITORY_PATTERN, 3),
    }


def clone_failure(message: Column) -> Column:
    lowered = F.lower(message)
    out = None
    for signs, code in CLONE_FAILURES:
        hit = lowered.contains(signs[0])
        for sign in signs[1:]:
            hit = hit | lowered.contains(sign)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(CLONE_OTHER)
