"""What may run and what may be shown: commands, arguments, environments and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that may and may not run, names that are always passed on, flags that
# the engine sets itself, and patterns of secrets.
ALLOWED = ("aquery", "build", "coverage", "cquery", "help", "info", "mod", "query", "test", "version")
DENIED = ("clean", "fetch", "mobile-install", "run", "shutdown", "sync")
PASSED_ON = ("HOME", "PATH", "TMPDIR", "TEMP", "TMP", "USER")
RESERVED = (
    "--build_event_binary_file", "--build_event_binary_file_path_conversion", "--build_event_publish_all_actions", "--build_event_json_file", "--build_event_text_file",
    "--color", "--curses", "--invocation_id", "--show_progress", "--show_result", "--subcommands", "--nosubcommands", "-s", "--run", "--norun", "--script_path",
    "--omit_run_args", "--noomit_run_args", "--experimental_run_bep_event_include_residue", "--noexperimental_run_bep_event_include_residue", "--run_under", "--run_env",
    "--test_output", "--test_summary", "--tool_tag")
SECRETS = (
    r"/Users/[^/\x00\s]+", r"/home/[^/\x00\s]+", r"(?i)[A-Z]:\\Users\\[^\\\x00\s]+", r"(?i)token=[^\x00\s]+", r"(?i)(api[_-]?key|password|secret)=[^\x00\s]+",
    r"(?i)(authorization|x-buildbuddy-api-key)[=:][ \t]*(basic|bearer)?[ \t]*[^\x00\s]+", r"(?i)[?&](x-amz-signature|x-goog-signature)=[^&\x00\s]+",
    r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"SECRET_SENTINEL")


def command_verdict(command: Column, allowed: tuple = ALLOWED, denied: tuple = DENIED) -> Column:
    """denied, unsupported or ok; what is denied stays so even if it is allowed too."""
    return F.when(command.isin(*denied), "denied").when(F.coalesce(~command.isin(*allowed), F.lit(True)), "unsupported").otherwise("ok")


def arguments_verdict(arguments: Column, count: int, one: int, total: int, reserved: tuple = RESERVED) -> Column:
    """The first rule that an array of arguments breaks, or null: too many; then of the first
    argument that is at fault: invalid (a NUL), too_long, too_large (together); then reserved."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(None).cast("string").alias("fault"))

    def step(s: Column, a: Column) -> Column:
        used = s["used"] + F.octet_length(a)
        fault = F.when(F.contains(a, F.lit("\0")), "invalid").when(F.octet_length(a) > one, "too_long").when(used > total, "too_large")
        return F.struct(used.alias("used"), F.coalesce(s["fault"], fault).alias("fault"))

    is_reserved = F.exists(arguments, lambda a: F.substring_index(a, "=", 1).isin(*reserved))
    return F.when(F.size(arguments) > count, "too_many").otherwise(F.coalesce(F.aggregate(arguments, zero, step, lambda s: s["fault"]), F.when(is_reserved, "reserved")))


def passed_on(environment: Column, more: tuple = ()) -> Column:
    """The entries of a map of strings that a run may see."""
    return F.map_filter(environment, lambda k, _: k.isin(*PASSED_ON, *more))


def holds_secret(text: Column, patterns: tuple = SECRETS) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_expired(terminal: Column, expires: Column, now: Column) -> Column:
    return F.coalesce(terminal & (expires <= now), F.lit(False))
