"""Column expressions over the texts of files, notes and generator replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits that results depend on.
SUMMARY_INPUT = 12_000
SHORT_SHA = 8
SNIPPET = 120
OVERVIEW = 200
LEAST_QUESTION = 10
MARKERS = ("TODO", "FIXME", "HACK")
SYNC_LOG_HEADING = "## 🔄 Sync Log"
_WHITE = r"(?U)\s"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """All white space off both ends, not spaces only."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def split_lines(text: Column) -> Column:
    """Lines however they end: by any line or paragraph separator, not by a newline only."""
    return F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]")


def head(text: Column, n: int = SUMMARY_INPUT) -> Column:
    return F.substring(text, 1, n)


def line_count(text: Column) -> Column:
    """Newlines plus one: how far a whole-file chunk reaches."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def strict_text(content: Column) -> Column:
    """UTF-8 bytes as text; null if they aren't valid."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def marker(line: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The first marker by priority, wherever it stands in the line; null without any."""
    found = F.lit(None).cast("string")
    for m in reversed(markers):
        found = F.when(line.contains(m), m).otherwise(found)
    return found


def questions(reply: Column, ending: str = "?", least: int = LEAST_QUESTION) -> Column:
    """Stripped lines that end with ``ending`` and have more than ``least`` characters."""
    return F.filter(F.transform(split_lines(reply), strip), lambda x: x.endswith(ending) & (F.length(x) > least))


def conflict(reply: Column) -> Column:
    """The verdict of a reply; one that can't be read counts as a conflict."""
    word = F.lower(F.regexp_extract(reply, r"(?i)CONFLICT:\s*(yes|no)", 1))
    return F.when(word == "", True).otherwise(word == "yes")


def reason(reply: Column) -> Column:
    return strip(F.regexp_extract(reply, r"(?is)REASON:\s*(.+)", 1))


def append_sync_log(note: Column, date: Column, sha: Column, verdict: Column) -> Column:
    """A dated entry right under the log's heading; the section is made at the end if missing."""
    entry = F.concat(F.lit("- "), date, F.lit(" — commit "), F.substring(sha, 1, SHORT_SHA), F.lit(": "), verdict)
    heading = rf"(?m)^[ \t]*{SYNC_LOG_HEADING}[ \t]*$"
    all_lines = F.split(note, "\n")
    at = F.array_position(F.transform(all_lines, strip), SYNC_LOG_HEADING).cast("int")
    inserted = F.array_join(F.concat(F.slice(all_lines, F.lit(1), at), F.array(entry), F.slice(all_lines, at + 1, F.size(all_lines))), "\n")
    added = F.concat(note, F.when(note.endswith("\n"), "").otherwise("\n"), F.lit(f"\n{SYNC_LOG_HEADING}\n"), entry, F.lit("\n"))
    return F.when(note.rlike(heading), inserted).otherwise(added)


def front_matter(note: Column) -> Column:
    """The text between the opening and closing ``---``; null without both."""
    return F.when(note.startswith("---") & (F.locate("\n---", note, 4) > 0), F.substring(note, F.lit(4), F.locate("\n---", note, 4) - 4))


def scalar_field(note: Column, key: str) -> Column:
    """A scalar of the front matter; the last one if repeated; null if absent."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), front_matter(note)), F.lit(rf"\n{key}: ([^\n]*\S)"), 1)
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def list_field(note: Column, key: str) -> Column:
    """The items of a list of the front matter; empty if absent or empty."""
    block = F.regexp_extract(F.concat(F.lit("\n"), front_matter(note), F.lit("\n")), rf"\n{key}:[ ]*\n((?:  [^\n]*\n)*)", 1)
    items = F.transform(F.filter(lines(F.coalesce(block, F.lit(""))), lambda x: x.startswith("  - ")), lambda x: F.substring(strip(x), 3, 1 << 30))
    return F.coalesce(items, F.array().cast("array<string>"))


def front_matter_map(note: Column) -> Column:
    """All fields of the front matter, map<string, array<string>>: a scalar is a list of one; empty without front matter.

    A line with ``: `` or a colon at its end begins a field; lines like ``  - x`` up to the next field are items of one
    without a value of its own; other lines count for nothing. Of fields with one name the last stands. Takes
    time in proportion to the lines, but for a sort of the fields.
    """
    item = lambda x: x.startswith("  - ")

    def starts(every: Column) -> Column:
        return F.filter(F.transform(every, lambda x, i: F.when(~item(x) & (x.contains(": ") | x.endswith(":")), i)), lambda i: i.isNotNull())

    def field(every: Column, begins: Column, at: Column, nth: Column) -> Column:
        line = F.get(every, at)
        value = strip(F.when(line.contains(": "), F.substring(line, F.locate(": ", line) + 2, F.lit(1 << 30))).otherwise(""))
        after = F.coalesce(F.get(begins, nth + 1), F.size(every))
        items = F.transform(F.filter(F.slice(every, at + 2, after - at - 1), item), lambda x: F.substring(strip(x), 3, 1 << 30))
        name = F.regexp_replace(strip(F.substring_index(line, ": ", 1)), ":+$", "")
        return F.struct(name.alias("name"), at.alias("at"), F.when(value == "", items).otherwise(F.array(value)).alias("values"))

    def last(found: Column) -> Column:
        kept = F.filter(found, lambda x, i: ~F.get(found, i + 1)["name"].eqNullSafe(x["name"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["values"])))

    every = F.filter(split_lines(F.coalesce(strip(front_matter(note)), F.lit(""))), lambda x: x.rlike(r"(?U)\S"))
    return let(every, lambda e: let(starts(e), lambda s: let(F.array_sort(F.transform(s, lambda at, nth: field(e, s, at, nth))), last)))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)


def overview_line(note: Column) -> Column:
    """The first telling line before any ``##``, else in the first ``##`` section; at most 200 characters."""
    close = F.locate("\n---", note, 4)
    body = F.when(close > 0, F.substring(note, close + 4, F.lit(1 << 30))).otherwise(note)
    stripped = F.transform(lines(body), strip)
    first_heading = F.coalesce(F.array_min(F.filter(F.transform(stripped, lambda x, i: F.when(x.startswith("##"), i)), lambda i: i.isNotNull())), F.size(stripped))
    rest = F.slice(stripped, first_heading + 2, F.size(stripped))
    second = F.coalesce(F.array_min(F.filter(F.transform(rest, lambda x, i: F.when(x.startswith("##"), i)), lambda i: i.isNotNull())), F.size(rest))

    def telling(part: Column) -> Column:
        kept = F.filter(part, lambda x: (x != "") & ~x.contains("placeholder") & ~x.startswith("<!--"))
        return F.get(kept, F.lit(0))

    return F.substring(F.coalesce(telling(F.slice(stripped, F.lit(1), first_heading)), telling(F.slice(rest, F.lit(1), second)), F.lit("")), 1, OVERVIEW)


def snippet(note: Column) -> Column:
    """Lines 4 to 7 of a note on one line, at most 120 characters."""
    return F.substring(strip(F.array_join(F.slice(lines(note), 4, 4), " ")), 1, SNIPPET)


def front_matter_line(key: str, value: object) -> str:
    """One field as front matter: a list, a boolean in lower case, or a scalar."""
    if isinstance(value, list):
        return "\n".join([f"{key}:", *(f"  - {item}" for item in value)])
    return f"{key}: {str(value).lower() if isinstance(value, bool) else value}"
