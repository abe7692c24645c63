"""Scalar text functions as Column expressions. Folding is ASCII only and bounds are bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ignore_case(c: Column, needle: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def strip_terminal(c: Column) -> Column:
    """Without ANSI sequences, and of each line what a terminal shows after its last CR. What goes
    is looked for from a line's start or a CR on only, so time is linear in the text."""
    def shown(x: Column) -> Column:
        plain = F.regexp_replace(x, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
        return F.regexp_replace(F.regexp_replace(plain, "\r+(\n|$)", "$1"), "(?<![^\n\r])[^\n\r]*+\r", "")

    # Most texts have neither.
    return once(c, lambda x: F.when(F.contains(x, F.lit("\x1b")) | F.contains(x, F.lit("\r")), shown(x)).otherwise(x))


def cut_to(c: Column, most: Column | int) -> Column:
    """The first `most` bytes, cut between characters: at most three bytes are given up."""
    most = F.lit(most) if isinstance(most, int) else most
    raw = c.cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(most - k, F.lit(0))).cast("string")) for k in range(4)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated and stands in the plan only once however often f uses it. No
    code is generated for f, which suits large expressions: of methods beyond 8,000 bytes of
    code the JVM compiles none."""
    return F.get(F.transform(F.array(c), f), 0)


def cut_bytes(c: Column, most: int) -> Column:
    """At most `most` bytes, cut between characters."""
    return once(c, lambda x: F.when(F.octet_length(x) <= most, x).otherwise(cut_to(x, most)))


def bounded(c: Column, most: int) -> Column:
    """As cut_bytes, with an ellipsis where something was cut."""
    return once(c, lambda x: F.when(F.octet_length(x) <= most, x).otherwise(F.concat(cut_to(x, most), F.lit("…"))))


def compact_path(c: Column, workspace: str | None = None) -> Column:
    """A path from the workspace on: without quotes, with forward slashes, and without what
    stands before a runfiles or execution root. The first rule that fits is the only one."""
    path = F.replace(F.trim(c, F.lit('"')), F.lit("\\"), F.lit("/"))
    if workspace:
        path = F.regexp_replace(path, r"^\Q" + workspace.rstrip("/") + r"/\E", "")
    path = F.regexp_replace(path, r"^(?:<WORKSPACE>|<workspace>)/", "")
    files = r"^(?s:.*)\.runfiles/_main/"
    old = r"^(?s:.*)\.runfiles/__main__/"
    root = r"^(?s:.*)/execroot/[^/]*/"
    last = r"^(?s:.*)/execroot/(?!(?s:.*)/execroot/)[^/]*/"
    return (F.when(path.rlike(files), F.regexp_replace(path, files, "")).when(path.rlike(old), F.regexp_replace(path, old, ""))
            .when(path.rlike(root), F.regexp_replace(path, last, "")).otherwise(F.regexp_replace(path, r"^\./", "")))


def redact(c: Column, patterns: list[str], most: int | None = None) -> Column:
    """Matches of each pattern in turn become a fixed word; the result has at most `most` bytes."""
    for p in patterns:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c if most is None else cut_bytes(c, most)


def starts_with_ignore_case(c: Column, prefix: str) -> Column:
    return ascii_lower(c).startswith(prefix.translate(str.maketrans(UPPER, LOWER)))


def ratio_percent(part: Column, whole: Column) -> Column:
    """100*part/whole, and 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))


def reduction_percent(base: Column, new: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise(F.lit(100.0) * (base - new) / F.nullif(base, F.lit(0)))


def seconds_to_ms(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    return F.when(bad, None).otherwise((F.when(bad, 0.0).otherwise(c) * 1000).cast("bigint"))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))


def uuid7_ms(c: Column) -> Column:
    return F.conv(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wildcard(c: Column, pattern: str) -> Column:
    """`prefix...` matches by prefix; `*` any run of characters; else equality."""
    if pattern.endswith("..."):
        return c.startswith(pattern[:-3])
    quoted = "".join(".*" if p == "*" else "\\Q" + p + "\\E" for p in _pieces(pattern))
    return c.rlike(f"^(?s:{quoted})$")


def _pieces(pattern: str) -> list[str]:
    out: list[str] = []
    for k, part in enumerate(pattern.split("*")):
        out += (["*"] if k else []) + ([part] if part else [])
    return out


def workspace_named(c: Column, workspace: str) -> Column:
    """The workspace's path becomes a fixed word, wherever it stands."""
    return F.replace(c, F.lit(workspace), F.lit("<workspace>"))


def padded_names(c: Column) -> Column:
    """The name of the workspace that was padded to keep a length becomes the plain one."""
    return F.regexp_replace(c, "<(?:WORKSPACE|workspace)>_*", "<workspace>")


def tool_version(c: Column) -> Column:
    """version and major of `bazel 7.4.1`; null if the text isn't of that form."""
    p = r"^bazel ((\d+)\S*)"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("version"), F.regexp_extract(c, p, 2).try_cast("int").alias("major")))


def lock_pid(c: Column) -> Column:
    """The number of the first line `pid=N` of a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(?m)^pid=(\d+)\s*$", 1), F.lit("")).try_cast("bigint")
