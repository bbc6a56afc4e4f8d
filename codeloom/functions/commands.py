"""What a shell command of an agent does, and what its output or its diff shows, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and markers.
BROAD_GREP = r"\s\.(\s|$)|\s(django|tests)/?(\s|$)|--include=.*\*\.|\bgrep\s+-[^\n]*[rR][^\n]*\s+.+\s+(\.|django/?|tests/?)\b"
WHOLE_FILE_CAT = r"(^|&&|\|\|)\s*cat\s+[^|><;&]+\.py\b"
WHOLE_FILE_NL = r"\bnl\s+-ba\s+[^|><;&]+\.py\b"
RANGE_READ = r"nl\s+-ba\s+[^|><;&]+\.py\s*\|\s*sed\s+-n\s+['\"]?(\d+),(\d+)p['\"]?"
LONGEST_RANGE = 140
HEREDOC = r"\bpython3?\s+<<['\"]?PY"
OPENS_TO_WRITE = r"open\s*\([^)]*,\s*['\"][wax]\+?['\"]"
WRITE_MARKERS = (".write_text(", ".write_bytes(", ".write(", "writelines(")
PATCHES = r"\bapply_patch\b|\bgit\s+apply\b"
WHOLE_SUITES = r"\bpython3?\s+tests/runtests\.py\b|\bpython3?\s+manage\.py\s+test\b"
TEST_FILE = r"::|\btests?/[^ ]+\.py\b"
LOOKS = r"grep|find |(^|\s)rg\s|nl -ba|(^|&&)\s*cat\s+|sed -n"
SUBMIT_MARK = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
IMPORTANT = r"\bpytest\b|\bdjango\s+test\b|\bdjango-admin\s+test\b|\bmanage\.py\s+test\b|\btests/runtests\.py\b|\bpip\s+install\b|\btox\b"
FAILURE_MARKERS = (
    "Traceback (most recent call last)", "ImportError:", "ModuleNotFoundError:", "RuntimeError:", "django.core.exceptions.ImproperlyConfigured",
    "ERROR:", "FAILED", "FAIL:", "FAILURES", "ERRORS", "metadata-generation-failed",
    "Encountered error while generating package metadata", "No such file or directory", "command not found",
)
#: A plain `git diff` or one of paths; none of history, of the index, or that hides or sums up the diff.
OTHER_DIFF = r"\bHEAD\b|\b[a-f0-9]{7,40}\b|\.\.\.?\S+|--(cached|staged|exit-code|quiet|name-only|name-status|stat|shortstat|summary|check)\b"
WRAPPED = r"(?s)^bash\s+-(?:c|lc)\s+(['\"])(.*)\1\s*$"
IN_PLACE = r"(?<!\S)-i(?:\S*)?(?!\S)|(?<!\S)--in-place(?:=\S+)?(?!\S)"
PIPEFAIL = ("set -o pipefail", "set -eo pipefail", "set -euo pipefail")
CUT_SHORT = r"\|\s*(head|tail)\b"
WRONG_PATH = r"/workspace/(django|tests|setup\.py|pyproject\.toml)\b"
AFTER_WRONG_CD = (
    r"\bgit\s+diff\b", r"\bgit\s+status\b", r"\bpython(?:3)?\s+tests/runtests\.py\b", r"\bpython(?:3)?\s+-m\s+pytest\b", r"\bpytest\b", r"\bpython(?:3)?\s+setup\.py\b",
    r"\bpython(?:3)?\s+<<['\"]?PY", r"\bpython(?:3)?\s+-c\b", r"\bgrep\b.*\bdjango/", r"\bnl\s+-ba\b.*\bdjango/",
)
ERROR_PLACE = (
    r"\bid=['\"][a-zA-Z_]+\.E\d+['\"]", r"\bmodels\.E\d+\b", r"\bfields\.E\d+\b", r"\badmin\.E\d+\b", "db_table .* is used by multiple models", "is used by multiple models",
    r"Traceback \(most recent call last\)", "AssertionError", "FAILED",
)
TARGETS_TESTS, TARGETS_SOURCE = r"(^|\s)(tests?/|tests\b)", r"(^|\s)(django/|django\b)"
SUBMIT_COMMAND = f"echo {SUBMIT_MARK}"
EMPTY_BLOB = "e69de29bb"
EMPTIED_HUNK = r"@@\s+-\d+,\d+\s+\+0,0\s+@@"


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def submits(command: Column) -> Column:
    return F.contains(command, F.lit(SUBMIT_MARK)) | F.contains(F.lower(command), F.lit("submit_final_output")) | (F.lower(F.trim(command)) == "submit")


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def shows_diff(command: Column, depth: int = 2) -> Column:
    """The diff of the working tree, seen whole: alone, after one `cd`, or as that in a `bash -c`; not piped, redirected or from a script."""
    c = F.trim(command)
    plain = lambda x: x.rlike(r"^git\s+diff(\s|$)") & ~x.rlike(OTHER_DIFF)
    parts = F.filter(F.transform(F.split(c, r"\s*&&\s*"), lambda p: F.trim(p)), lambda p: p != "")
    after_cd = F.get(parts, F.lit(0)).rlike(r"^cd\s+.+$") & plain(F.get(parts, F.lit(1)))
    here = F.when(F.size(parts) == 1, plain(F.get(parts, F.lit(0)))).when(F.size(parts) == 2, after_cd).otherwise(False)
    if depth:
        here = F.when(c.rlike(WRAPPED), shows_diff(F.regexp_extract(c, WRAPPED, 2), depth - 1)).otherwise(here)
    hidden = c.rlike(r"(?s)\bpython(?:3)?\b.*\bgit\s+diff\b") | c.rlike(r"(^|[;&|]\s*)git\s+show(\s|$)") | c.rlike("[|<>]")
    return F.coalesce(~hidden & here, F.lit(False))


def edits_in_place(command: Column) -> Column:
    """A `sed` of the command that changes its file."""
    parts = F.transform(F.split(command, r"\s*(?:&&|\|\||;)\s*"), lambda p: F.trim(p))
    return F.exists(parts, lambda p: p.rlike(r"^(sudo\s+)?sed\b") & p.rlike(IN_PLACE))


def loses_status(command: Column) -> Column:
    """A test or an installation cut by head or tail, whose failure the shell wouldn't tell."""
    low = F.lower(command)
    return low.rlike(CUT_SHORT) & low.rlike(IMPORTANT) & ~any_of(command, PIPEFAIL)


def wrong_root(command: Column) -> Column:
    """Works in the folder above the repository as if it were the repository."""
    c = F.trim(command)
    looks = c.rlike(r"^ls\s+/?workspace/?\s*$") | c.rlike(r"^find\s+/workspace\b")
    return ~looks & (command.rlike(WRONG_PATH) | (command.rlike(r"cd\s+/workspace\s*&&") & matches(command, AFTER_WRONG_CD)))


def shows_error_place(command: Column, output: Column) -> Column:
    """An output that names an error or a failure and comes from source files, not from tests alone or from a rule of ours."""
    text, command = F.coalesce(output, F.lit("")), F.coalesce(command, F.lit(""))
    at_source = text.rlike(r"(^|\n)\.?/?[A-Za-z0-9_./-]+\.py:\d+:") & ~text.rlike(r"(^|\n)\.?/?tests?/") | text.rlike(r"(^|\n)\.?/?django/[A-Za-z0-9_./-]+\.py:\d+:")
    return ~F.ltrim(text).startswith("[policy error]") & matches(text, ERROR_PLACE) & (command.rlike(TARGETS_SOURCE) | at_source)


def edits(command: Column) -> Column:
    """A script counts only if it writes."""
    writes = any_of(command, WRITE_MARKERS) | command.rlike(OPENS_TO_WRITE)
    return F.when(command.rlike(HEREDOC), writes).otherwise(command.rlike(PATCHES))


def tests(command: Column) -> Column:
    """A test run that names a file or a case, a whole known suite, or a script."""
    return F.when(F.lower(command).rlike(r"\bpytest\b"), command.rlike(TEST_FILE)).otherwise(F.lower(command).rlike(WHOLE_SUITES) | command.rlike(HEREDOC))


def reads_range(command: Column) -> Column:
    first, last = (F.regexp_extract(command, RANGE_READ, k).try_cast("bigint") for k in (1, 2))
    return F.coalesce((first > 0) & (first <= last) & (last - first <= LONGEST_RANGE), F.lit(False))


def searches_broadly(command: Column) -> Column:
    whole = command.rlike(WHOLE_FILE_CAT) | (command.rlike(WHOLE_FILE_NL) & ~F.contains(command, F.lit("sed -n")))
    return (command.rlike(r"\bgrep\b") & command.rlike(BROAD_GREP)) | whole


def kind(command: Column, tool: Column | None = None) -> Column:
    """edit, test, diff, submit, small_read, broad, inspect or other; a call of a retrieval tool is broad, no command is other."""
    c = F.trim(F.coalesce(command, F.lit("")))
    found = F.when(c == "", "other").when(edits(c), "edit").when(tests(c), "test").when(shows_diff(c), "diff").when(submits(c), "submit")
    found = found.when(reads_range(c), "small_read").when(searches_broadly(c), "broad").when(F.lower(c).rlike(LOOKS), "inspect").otherwise("other")
    return found if tool is None else F.when(tool.isNotNull(), "broad").otherwise(found)


def failed_quietly(command: Column, output: Column, returncode: Column) -> Column:
    """A test or an installation that returned 0 though its output tells of a failure."""
    ran = (F.coalesce(returncode, F.lit(0)) == 0) & F.lower(F.coalesce(command, F.lit(""))).rlike(IMPORTANT)
    return ran & any_of(F.coalesce(output, F.lit("")), FAILURE_MARKERS)


def destructive(diff: Column) -> Column:
    """A diff that empties a file, or deletes far more than it adds."""
    diff = F.coalesce(diff, F.lit(""))
    lines = F.filter(F.split(diff, "\n"), lambda x: ~x.startswith("---") & ~x.startswith("+++"))
    gone, new = F.size(F.filter(lines, lambda x: x.startswith("-"))), F.size(F.filter(lines, lambda x: x.startswith("+")))
    many = (gone >= 80) & (new <= 5) | (gone >= 120) & (gone >= 10 * F.greatest(new, F.lit(1)))
    return F.contains(diff, F.lit(EMPTY_BLOB)) | diff.rlike(EMPTIED_HUNK) | many


def submission(output: Column, returncode: Column) -> Column:
    """What follows the line that ends a task; null where the first line isn't that mark or the command failed."""
    first = F.trim(F.split_part(F.ltrim(output), F.lit("\n"), F.lit(1)))
    rest = F.regexp_extract(F.ltrim(output), r"(?s)^[^\n]*\n(.*)$", 1)
    return F.when((first == SUBMIT_MARK) & (F.coalesce(returncode, F.lit(0)) == 0), rest)
