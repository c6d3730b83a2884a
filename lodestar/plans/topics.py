"""Topics: batch lines, tagged topic files, and stopping and normalising of query texts."""

from __future__ import annotations

import html
import re

from lodestar.functions.text import WORD_OR_NUMBER

# Common English words, the default when no stop list is given.
ENGLISH_STOP = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing
down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on
once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until
up very was we were what when where which while who whom why will with would you your yours""".split()
)


def batch_line(line: str) -> tuple[str, str]:
    """``id words`` of one line."""
    name, _, text = line.strip().partition(" ")
    return name, text.strip()


def _fields(body: str, names: dict[str, str], wanted: str) -> str:
    out = []
    for letter in wanted:
        tag = names[letter]
        if m := re.search(rf"<{tag}>(.*?)(?=</{tag}>|<\w+>|</top>|</topic>|\Z)", body, re.S | re.I):
            text = re.sub(r"^\s*(?:Topic|Description|Narrative)\s*:", "", m[1].strip(), flags=re.I)
            out.append(" ".join(html.unescape(text).split()))
    return " ".join(x for x in out if x)


def trec_topics(source: str, wanted: str = "t") -> list[tuple[str, str]]:
    """(number, text) of ``<top>`` elements; of title (t), description (d) and narrative (n) those that are wanted."""
    out = []
    for m in re.finditer(r"<top>(.*?)</top>", source, re.S | re.I):
        number = re.search(r"<num>\s*(?:Number\s*:)?\s*(\S+)", m[1], re.I)
        if number:
            out.append((number[1].removesuffix("</num>"), _fields(m[1], {"t": "title", "d": "desc", "n": "narr"}, wanted)))
    return out


def inex_topics(source: str, wanted: str = "t") -> list[tuple[str, str]]:
    """(id, text) of ``<topic>`` elements; title (t), castitle (c), description (d), narrative (n)."""
    out = []
    for m in re.finditer(r"<(?:inex_)?topic\b([^>]*)>(.*?)</(?:inex_)?topic>", source, re.S | re.I):
        number = re.search(r"\b(?:topic_id|id)\s*=\s*[\"']?([^\"'\s>]+)", m[1])
        if number:
            out.append((number[1], _fields(m[2], {"t": "title", "c": "castitle", "d": "description", "n": "narrative"}, wanted)))
    return out


_PYTHON_TOKEN = re.compile(r"[^\W\d_]+|\d+")
assert WORD_OR_NUMBER  # the same classes in Spark's dialect


def words(text: str) -> list[str]:
    return _PYTHON_TOKEN.findall(text.lower())


def stop(terms: list[str], stop_words: tuple[str, ...] = ENGLISH_STOP, numbers: bool = False, short: bool = False) -> list[str]:
    """Without stop words, and if asked for without numbers and words of two letters or fewer; all terms if none would be left."""
    drop = frozenset(stop_words)
    kept = [t for t in terms if t not in drop and not (numbers and t.isdigit()) and not (short and len(t) <= 2)]
    return kept or terms
