"""Definitions of languages without a parser here: heads by pattern, ends by braces, ``end`` words or layout.

Strings and comments are blanked first, in place, so neither a brace nor a keyword in them counts. A head that a brace
follows reaches to the brace that closes it; one of a language with ``end`` words to the word that closes it; one of a
layout language to the last line that is indented below it. Nested definitions are chunks of their own, too. A file
without any is one chunk. What isn't closed reaches to the end. Patterns are bounded, so time grows with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"
_DOUBLE, _SINGLE, _TRIPLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r'"""(?s:.*?)(?:"""|\Z)'
_HASH = r"\#[^\n]*"
_NOT = r"(?!(?:return|new|else|elseif|if|for|foreach|while|switch|catch|throw|case|do|try|using|lock|synchronized|await|yield|goto|delete|typedef|echo|in|when|assert|import|package|namespace)\b)"
_ARGS = r"\([^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*\)"
_TO_BRACE = r"[^;{}]{0,500}?(?=\{)"
_WORDS = r"(?:[\w<>\[\].,?:@]+[ \t\n*&]+)"  # no sign in both classes, so a text is cut into words in one way


@dataclass(frozen=True)
class Rules:
    """What is blanked, what begins a definition (at the beginning of a line), and how it ends."""

    skip: str
    heads: tuple[str, ...]
    ends: str = "braces"
    opens: str = ""
    closes: str = r"\bend\b"


RULES = {
    "java": Rules(f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}", (
        rf"(?:@\w+(?:\([^()]*\))?\s+)*(?:\w[\w-]*[ \t]+)*?(?:class|interface|enum|record)\s+\w+{_TO_BRACE}",
        rf"{_NOT}{_WORDS}{{1,8}}\w+\s*{_ARGS}\s*(?:throws\s+[\w.,\s]{{1,200}}?)?(?=[{{;])",
        rf"{_NOT}\w+\s*{_ARGS}\s*(?:throws\s+[\w.,\s]{{1,200}}?)?(?=\{{)",
    )),
    "csharp": Rules(rf'@"(?:""|[^"])*"|{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}', (
        rf"(?:\w+[ \t]+)*?(?:class|struct|interface|record)\s+\w+{_TO_BRACE}",
        rf"{_NOT}{_WORDS}{{1,8}}\w+\s*{_ARGS}\s*(?:where\s[^;{{}}]{{1,200}}?)?(?=[{{;])",
        rf"{_NOT}(?:\w+[ \t]+){{0,3}}\w+\s*{_ARGS}\s*(?::\s*(?:base|this)\s*{_ARGS}\s*)?(?=\{{)",
        r"(?:(?:public|protected|private|internal|static|virtual|override|abstract|required)\s+)+[\w<>\[\],.?]+\s+\w+\s*(?=\{)",
    )),
    "kotlin": Rules(f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}", (rf"(?:\w+[ \t]+)*?(?:fun|class|object|companion\s+object)\b(?:[^\n{{=(;]|{_ARGS})*",)),
    "scala": Rules(f"{_TRIPLE}|{_DOUBLE}|{_LINE}|{_BLOCK}", (rf"(?:\w+[ \t]+)*?(?:class|object|trait|def)\b(?:[^\n{{=(;]|{_ARGS})*(?:=[ \t]*(?=\{{))?",)),
    "rust": Rules(rf'{_DOUBLE}|\'(?:\\.|[^\'\\\n])\'|{_LINE}|{_BLOCK}', (
        rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+\w+{_TO_BRACE}",
        rf"(?:unsafe\s+)?impl\b{_TO_BRACE}",
    )),
    "php": Rules(rf"{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}|\#(?!\[)[^\n]*", (
        rf"(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\w+\s*{_ARGS}[^;{{}}]{{0,200}}?(?=[{{;])",
        rf"(?:(?:abstract|final|readonly)\s+)*class\s+\w+{_TO_BRACE}",
    )),
    "c": Rules(f"{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}", (rf"{_NOT}{_WORDS}{{1,8}}\w+\s*{_ARGS}\s*(?=\{{)",)),
    "cpp": Rules(f"{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}", (
        rf"{_NOT}(?!(?:public|private|protected)\s*:){_WORDS}{{0,8}}[\w:~]+\s*{_ARGS}\s*(?:(?:const|noexcept|override|final)\s*)*(?::[^;{{}}]{{1,300}}?)?(?=\{{)",
        rf"(?:template\s*<[^;{{}}]{{0,200}}>\s*)?class\s+\w+{_TO_BRACE}",
    )),
    "shell": Rules(rf"(?<![\w$\\{{]){_HASH}|{_DOUBLE}|'[^']*'?", (r"(?:function\s+[\w-]+\s*(?:\(\s*\))?|[\w-]+\s*\(\s*\))\s*(?=\{)",)),
    "lua": Rules(rf"--\[\[(?s:.*?)(?:\]\]|\Z)|--[^\n]*|\[\[(?s:.*?)(?:\]\]|\Z)|{_DOUBLE}|{_SINGLE}", (r"(?:local\s+)?function\s+[\w.:]+",), "words", r"\b(?:function|if|do|repeat)\b", r"\b(?:end|until)\b"),
    "ruby": Rules(rf"^=begin(?s:.*?)(?:^=end|\Z)|{_HASH}|{_DOUBLE}|{_SINGLE}", (r"(?:def|class|module)\b[^\n]*",), "words",
        r"^[ \t]*(?:while|until|for)\b[^\n]*?\bdo\b|^[ \t]*(?:if|unless|while|until|for|case|begin)\b|=[ \t]*(?:if|unless|case|begin)\b|(?<![.:\w])(?:class|module|def|do)\b(?![?!:])", r"(?<![.:\w])end\b(?![?!:])"),
    "elixir": Rules(rf"{_TRIPLE}|{_HASH}|{_DOUBLE}|{_SINGLE}", (r"(?:def|defp|defmodule|defmacro|defmacrop)\s(?:[^\n]*\n){0,20}?[^\n]*?(?=\bdo\b)",), "words", r"\bdo\b(?!:)|\bfn\b", r"\bend\b"),
    "haskell": Rules(rf"\{{-(?s:.*?)(?:-\}}|\Z)|--[^\n]*|{_DOUBLE}", (r"(?<![^\n])(?!(?:module|import|data|type|newtype|class|instance|where|infixl?|infixr|deriving|foreign|default)\b)[a-z_][\w']*",), "layout"),
}
_NOT_NEWLINE = re.compile(r"[^\n]")


@cache
def _compiled(language: str) -> tuple[re.Pattern, re.Pattern, re.Pattern | None]:
    rules = RULES[language]
    heads = "|".join(f"(?:{h})" for h in rules.heads)
    words = re.compile(f"(?P<open>{rules.opens})|(?P<close>{rules.closes})", re.M) if rules.opens else None
    return re.compile(rules.skip, re.M), re.compile(rf"^[ \t]*(?P<head>{heads})", re.M), words


def _closing(marks: Iterator[tuple[int, int, bool]], end: int) -> dict[int, int]:
    """Where what opens at a place is closed (the end of the closing mark)."""
    stack, found = [], {}
    for start, stop, opens in marks:
        if opens:
            stack.append(start)
        elif stack:
            found[stack.pop()] = stop
    return found | dict.fromkeys(stack, end)


def definitions(language: str, source: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of every definition, in order; the whole file if there is none."""
    skip, heads, words = _compiled(language)
    text = skip.sub(lambda m: _NOT_NEWLINE.sub(" ", m[0]), source)
    size, ends = len(text), RULES[language].ends
    if ends == "braces":
        close = _closing(((m.start(), m.end(), m[0] == "{") for m in re.finditer(r"[{}]", text)), size)
    elif ends == "words":
        close = _closing(((m.end("open") if m["open"] else m.start(), m.end(), bool(m["open"])) for m in words.finditer(text)), size)
        opened = sorted(close)
    newlines = [m.start() for m in re.finditer("\n", source)]
    line_end = lambda at: newlines[k] if (k := bisect_right(newlines, at - 1)) < len(newlines) else size
    found = []
    for m in heads.finditer(text):
        start, stop = m.start("head"), m.end()
        if ends == "braces":
            after = re.compile(r"\s*").match(text, stop).end()
            follows = text[after : after + 1]
            stop = close[after] if follows == "{" else (after + 1 if follows == ";" else line_end(stop))
        elif ends == "words":
            k = bisect_right(opened, start)
            stop = close[opened[k]] if k < len(opened) and (language != "elixir" or text.startswith("do", stop) and not text.startswith("do:", stop)) else line_end(stop)
        else:
            rest = re.compile(r"[^\n]*(?:\n(?:[ \t]+[^\n]*)?(?=\n|[ \t]|\Z)|\n[ \t]+[^\n]+)*").match(text, start)
            stop = start + len(text[start : rest.end()].rstrip())
        found.append((bisect_right(newlines, start - 1) + 1, bisect_right(newlines, stop - 1) + 1, source[start:stop]))
    return found or [(1, len(newlines) + 1, source)]
