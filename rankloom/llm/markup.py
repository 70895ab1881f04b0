"""From texts with HTML, Markdown, wiki or LaTeX markup to readable text.

Constructs of markup are converted and leave a sign where they stood; then the text is cut into blocks, and each block holds the signs of its own lines. The first pass decides what it
can: a block with a sign belongs to that kind of markup; a block of running words is content by its stop-word density, length and link density, a block of links is residue. In
the second pass what is left, short or ambiguous blocks (a line in stars, a line after a colon, a lone quotation mark), inherits label and kind from the nearest decided neighbours. The
kinds of a text are those of its blocks. Headings, lists, code, tables and formulas keep their structure in one plain notation: ``#`` by level, ``-`` or numbers indented by
depth, fences with the language, ``|`` and dollar signs. Stop words are those of the corpus, by language.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.shared import spread, stored

KINDS = ("html", "latex", "markdown", "wiki")

# Element names of HTML, those that stand alone, and those whose end may be left out.
ELEMENTS = (
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead "
    "time title tr tt u ul var video"
).split()
ALONE = set("br hr img input meta link col".split())
OPEN_ENDED = set("p li tr td th dt dd".split())

# Frequent function words of the six languages, for a text without a corpus.
STOP = set(
    "the a an of to in and is it that for on with as was at by from be this are or not which but after before during until "
    "der die das und in den von zu mit auf für ist im dem nicht ein eine nach bis wegen trotz gemäß aber ohne des "
    "le la les de des du et à un une en pour par sur avec dans que qui malgré mais au aux sans est ne pas "
    "el los las y del al un una por con para se que sin según pero hasta lo su "
    "o os as e da do dos das em no na nos nas um uma por com para até sem mas ao que não".split()
)
STOP_HAN = set("的了在是和与并而但为于按由从到对等之个")

_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = regex.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>", regex.S | regex.I)
_ENTITY = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
#: What a converted construct leaves behind.
_SIGN = {"html": "\ue010", "latex": "\ue011", "markdown": "\ue012", "wiki": "\ue013"}
_KIND = {v: k for k, v in _SIGN.items()}
_SIGNS = regex.compile("[\ue010-\ue013]")
_PRIVATE = regex.compile("[\ue000-\ue013]")
_UNSEEN = regex.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", regex.S | regex.I)
_FENCE = regex.compile(r"^[ ]{0,3}(```+|~~~+)[ ]*([\w+-]*)[ ]*\n(.*?)(?:^[ ]{0,3}\1[ ]*$|\Z)", regex.M | regex.S)
_PRE = regex.compile(r"<pre\b([^<>]*>(?:\s*<code\b[^<>]*>)?)(.*?)</pre\s*>", regex.S | regex.I)
_CLASS = regex.compile(r"(?:language|lang|brush:)-?\s*([A-Za-z][\w+#]*)")
_MD_LINK = regex.compile(r"(?<![A-Za-z0-9_\]])(!?)\[([^\[\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_MD_STRONG = regex.compile(r"(?<![A-Za-z0-9_*\\])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?![A-Za-z0-9_*])")
_MD_EM = regex.compile(r"(?<![\w*\\/])\*(?=\p{L})([^*\n]*?[\p{L}\p{N}.!?])\*(?![\w*/])")
_MD_UNDER = regex.compile(r"(?<![\w\\])__(?=\S)([^_\n]*\s[^_\n]*?\S)__(?!\w)")
_MD_STRIKE = regex.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
_MD_CODE = regex.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_MD_HEAD = regex.compile(r"^#{1,6}[ \t]+(?=\S)(.*?)[ \t]*#*$")
_MD_RULE = regex.compile(r"^\|?[ ]*:?-{2,}:?[ ]*(?:\|[ ]*:?-{2,}:?[ ]*)+\|?[ ]*$|^\|[ ]*:?-{2,}:?[ ]*\|[ ]*$")
_MD_TASK = regex.compile(r"^[ \t]*[-*+][ ]\[[ xX]\][ ]+(.*)$")
_MD_QUOTE = regex.compile(r"^[ ]{0,3}(?:>[ ]?)+(?=\S)(.*)$")
_UNDERLINE = regex.compile(r"^(?:={3,}|-{3,})[ ]*$")
_WIKI_HEAD = regex.compile(r"^(={2,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_WIKI_LINK = regex.compile(r"(?<![A-Za-z0-9_\[])\[\[(?=\S)([^\[\]\n|]+)(?:\|([^\[\]\n]*))?(?<=\S)\]\](?!\])")
_WIKI_TEMPLATE = regex.compile(r"\{\{[ ]*[\p{L}#][^{}|]*\|[^{}]*\}\}")
_WIKI_BRACES = regex.compile(r"\{\{[ ]*[\p{L}][^{}|\n]*\}\}")
_WIKI_STRONG = regex.compile(r"(?<!')'{3}(?=[^\s'])([^\n]*?[^\s'])'{3}(?!')")
_WIKI_EM = regex.compile(r"(?<!')''(?=[^\s'])([^'\n]*[^\s'])''(?!')")
_WIKI_TABLE = regex.compile(r"^\{\|[^\n]*\n(.*?)^\|\}", regex.M | regex.S)
_WIKI_TAG = regex.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?nowiki/?>|__(?:NO)?TOC__", regex.S)
_WIKI_DEEP = regex.compile(r"^(?:\*{2,}|#{2,}|:+|[*#]+:+)[ ]+(?=\S)")
_TEX_COMMAND = regex.compile(r"(?<![A-Za-z0-9_:\\/])\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{")
_TEX_AFTER = regex.compile(r"(?<=[A-Za-z0-9~}])\\(?:footnote|ref|cite|label|eqref|pageref|index)\*?\{")
_TEX_ITEM = regex.compile(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*(.*)$")
_TEX_MATH = regex.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?(?:\\[A-Za-z]+|\^|_\{|_[A-Za-z0-9](?![A-Za-z0-9]))[^$\n]*?)(?<=\S)\$(?!\d)|\$\$(?=.*[\\^_=])([^$]+?)\$\$")
_TEX_DISPLAY = regex.compile(r"(?<![\\\w:])\\\[(?=[^\]]*[\\^_=])(.+?)\\\]|(?<![\\\w:])\\\((?=.*?[\\^_=])(.+?)\\\)", regex.S)
_TEX_ESCAPE = regex.compile(r"(?<=\d)\\%|(?<=[\w ])\\[&#_](?=[ \w])")
_TEX_ENV = regex.compile(r"^[ \t]*\\(?:begin|end)\{([A-Za-z]+\*?)\}[^\n]*$", regex.M)
_TEX_VERBATIM = regex.compile(r"\\begin\{(verbatim|lstlisting|minted)\}([^\n]*)\n(.*?)\\end\{\1\}", regex.S)
_TEX_LIST = regex.compile(r"^[ \t]*\\(begin|end)\{(itemize|enumerate|description)\*?\}[^\n]*$|^[ \t]*\\(item)\b(?:\[[^\]\n]*\])?[ \t]*", regex.M)
_TEX_SECTION = regex.compile(r"\\((?:sub)*)section\*?\{([^{}]*)\}")
_LIST = regex.compile(r"^([ \t]*)([-*+•]|\d{1,3}[.)])[ \t]+(?=\S)(.*)$")
_HAN = regex.compile("[一-鿿]")
_BLANKS = regex.compile(r"[ \t]+")
_RULER = regex.compile(r"-{4,}|\*{3,}|_{3,}")
_WIKI_ANY_HEAD = regex.compile(r"^={2,6}[^=].*={2,6}[ \t]*$", regex.M)
_WIKI_ROW = regex.compile(r"^\|-.*$", regex.M)
_TEX_ANY_ITEM = regex.compile(r"^[ \t]*\\item\b(?!\\)", regex.M)
_TEX_GONE = regex.compile(r"\\(?:label|ref|cite|eqref|pageref|index)\*?\{[^{}]*\}")
_TEX_NOTE = regex.compile(r"\\footnote\{([^{}]*)\}")
_TEX_INNER = regex.compile(r"(?<![A-Za-z0-9_:\\/])\\(?:href\{[^{}]*\}|[A-Za-z]+)\*?\{([^{}]*)\}")
_TEX_QUOTED = regex.compile(r"\\([%&#_${}])")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_HOLD = regex.compile("\ue000(\\d+)\ue001")


@dataclass
class Block:
    """A run of lines with one function. kind: text, heading, item, code, table, formula. level: of a heading from 1, of an item from 0. sign: an item's own, or a code's language.
    label: content, residue or None while undecided."""

    kind: str
    text: str
    marks: set = field(default_factory=set)
    hints: set = field(default_factory=set)
    inherited: set = field(default_factory=set)
    links: int = 0
    level: int = 0
    sign: str = ""
    label: str | None = None


def _real_tags(text: str) -> list:
    """Tags that are markup. Names that are no elements are type parameters or placeholders, and so is an element's name that
    stands alone: it must be closed, carry attributes or need no end."""
    tags = [m for m in _TAG.finditer(text) if m[2].lower() in ELEMENT_SET]
    closed = {m[2].lower() for m in tags if m[1]}
    opened = {m[2].lower() for m in tags if not m[1]}
    out = []
    for m in tags:
        name, before = m[2].lower(), text[m.start() - 1 : m.start()]
        glued = before.isascii() and (before.isalnum() or before == "_")
        if m[1]:
            real = name in opened
        elif name in ALONE:
            real = not glued or bool(m[4]) or name == "br"
        else:
            real = name in closed or "=" in m[3] or (name in OPEN_ENDED and not glued and (not before or before == "\n"))
        if real:
            out.append(m)
    return out


ELEMENT_SET = set(ELEMENTS)


class Cleaner:
    """Turns one text after another into blocks, kinds of markup and plain text. stop, stop_han: stop words and single Han characters."""

    def __init__(self, stop: set | None = None, stop_han: set | None = None):
        self.stop, self.stop_han = STOP if stop is None else stop, STOP_HAN if stop_han is None else stop_han

    def __call__(self, text: str | None) -> tuple[list[str], str, int, int]:
        """(kinds, plain text, blocks, blocks left out as residue)."""
        if not text or not text.strip():
            return [], "", 0, 0
        blocks = self._blocks(text.replace("\r\n", "\n").replace("\r", "\n"))
        self._inherit(blocks)
        marks = {m for b in blocks for m in b.marks}
        blocks = [b for b in blocks if b.text.strip() or not b.marks]  # a sign alone on its line is no block of the text
        kept = [b for b in blocks if b.label != "residue" and b.text.strip()]
        return sorted(marks), self._plain(kept), len(blocks), len(blocks) - len(kept)

    def _blocks(self, text: str) -> list[Block]:
        held: list[tuple[str, str, str]] = []

        def hold(kind: str, body: str, language: str = "") -> str:
            held.append((kind, body, language))
            return f"\ue000{len(held) - 1}\ue001"

        def code(kind: str, group: int, head: int):
            def put(m) -> str:
                body, about = m[group], m[head] or ""
                if kind == "html":
                    body = html.unescape(_TAG.sub("", body))
                    about = found[1] if (found := _CLASS.search(about)) else ""
                elif kind == "latex":
                    about = found[1] if (found := regex.search(r"language=\s*\{?([\w+#]+)", about) or regex.search(r"\{([\w+#]+)\}", about)) else ""
                return "\n" + _SIGN[kind] + hold("code", body.strip("\n"), about.lower()) + "\n"

            return put

        def maths(m) -> str:
            body = (m[1] or m[2]).strip()
            return _SIGN["latex"] + hold("formula", body) if m[0].startswith("$") and not m[0].startswith("$$") else "\n" + _SIGN["latex"] + hold("display", body) + "\n"

        # Code and formulas first: what they hold is no markup.
        text = _PRIVATE.sub("", text)
        # Most texts lack the characters that a construct begins with.
        if "```" in text or "~~~" in text:
            text = _FENCE.sub(code("markdown", 3, 2), text)
        if "\\" in text:
            text = _TEX_VERBATIM.sub(code("latex", 3, 2), text)
        if "<" in text:
            text = _PRE.sub(code("html", 2, 1), text)
        if "\\" in text:
            text = _TEX_DISPLAY.sub(maths, text)
        if "$" in text:
            text = _TEX_MATH.sub(maths, text)
        if "`" in text:
            text = _MD_CODE.sub(lambda m: _SIGN["markdown"] + hold("word", m[1]), text)
        text = self._html(text)
        text = self._wiki(text)
        text = self._tex(text)
        blocks = self._lines(text)
        for b in blocks:
            while _HOLD.search(b.text):
                alone = _HOLD.fullmatch(b.text.strip())
                if alone and held[int(alone[1])][0] in ("code", "display"):
                    kind, _, language = held[int(alone[1])]
                    b.kind, b.sign = ("code", language) if kind == "code" else ("formula", "")
                b.text = _HOLD.sub(lambda m: f"${held[int(m[1])][1]}$" if held[int(m[1])][0] == "formula" else held[int(m[1])][1], b.text)
        return blocks

    def _html(self, text: str) -> str:
        sign = _SIGN["html"]
        tags = []
        if "<" in text:
            text = _UNSEEN.sub(sign, _COMMENT.sub(sign, text))
            tags = _real_tags(text)
        if tags:
            out, at, cells = [], 0, 0
            lists: list[int] = []  # of each open list the last number, 0 for bullets
            for m in tags:
                out += [text[at : m.start()], ""]
                at = m.end()
                name, end = m[2].lower(), bool(m[1])
                if name[0] == "h" and name[1:].isdigit():
                    out.append("\n" if end else f"\n\n{'#' * int(name[1])} \ue002")
                elif name in ("ul", "ol"):
                    if not end:
                        lists.append(1 if name == "ol" else 0)
                    elif lists:
                        lists.pop()
                    out.append("\n\n" if not lists or (not end and len(lists) == 1) else "\n")
                elif name == "li":
                    if not end:
                        number = lists[-1] if lists else 0
                        if number:
                            lists[-1] += 1
                        out.append("\n" + "  " * max(0, len(lists) - 1) + (f"{number}. " if number else "- "))
                elif name == "tr":
                    cells = 0
                    out.append(" |\n" if end else "\n| ")
                elif name in ("td", "th"):
                    out.append("" if end else " | " * (cells > 0))
                    cells += not end
                elif name == "br":
                    out.append("\n")
                elif name == "a":
                    out.append("\ue003")
                elif name in ("p", "div", "table", "blockquote", "section", "article", "header", "footer", "nav", "hr"):
                    out.append("\n\n")
                out.append(sign)
            out.append(text[at:])
            text = "".join(out)

        def entity(m) -> str:
            return sign + html.unescape(m[0]).replace("\u00a0", " ") if m[0][1] == "#" or m[0][1:] in html5 else m[0]

        return _ENTITY.sub(entity, text) if "&" in text else text

    def _wiki(self, text: str) -> str:
        found = 0

        def use(needs: str, pattern, put, s: str) -> str:
            nonlocal found
            if needs not in s:
                return s
            out, n = pattern.subn(lambda m: _SIGN["wiki"] + put(m), s)
            found += n
            return out

        def cells(m) -> str:
            rows = []
            for row in _WIKI_ROW.split(m[1]):
                parts = [p.strip() for line in row.split("\n") if line[:1] in "|!" and line for p in regex.split(r"\|\||!!", line[1:])]
                if parts:
                    rows.append("| " + " | ".join(parts) + " |")
            return "\n\n" + _SIGN["wiki"] + "\n".join(rows) + "\n\n"

        text = use("{|", _WIKI_TABLE, cells, text)
        text = use("", _WIKI_TAG, lambda m: "", text)
        text = use("{{", _WIKI_TEMPLATE, lambda m: "", text)
        text = use("[[", _WIKI_LINK, lambda m: "" if m[1].lower().startswith(("category:", "file:", "image:")) else (m[2] or m[1]), text)
        text = use("'''", _WIKI_STRONG, lambda m: m[1], text)
        text = use("''", _WIKI_EM, lambda m: m[1], text)
        if found or _WIKI_ANY_HEAD.search(text):
            text = _WIKI_BRACES.sub("", text)
        return text

    def _tex(self, text: str) -> str:
        if "\\" not in text:
            return text
        sign = _SIGN["latex"]
        where = [m.start() for p in (_TEX_COMMAND, _TEX_AFTER, _TEX_ESCAPE, _TEX_ANY_ITEM) for m in p.finditer(text)]
        if not where:
            return text
        # A sign before each construct, on its line; commands are looked for behind it.
        out, at = [], 0
        for w in sorted(set(where)):
            line = text.rfind("\n", 0, w) + 1
            if line >= at:
                out += [text[at:line], sign]
                at = line
        text = "".join([*out, text[at:]]).replace(sign, sign + "\n")
        lists: list[int] = []

        def item(m) -> str:
            if m[1] == "begin":
                lists.append(1 if m[2] == "enumerate" else 0)
            elif m[1] == "end":
                if lists:
                    lists.pop()
            else:
                number = lists[-1] if lists else 0
                if number:
                    lists[-1] += 1
                return "  " * max(0, len(lists) - 1) + (f"{number}. " if number else "- ")
            return ""

        text = _TEX_LIST.sub(item, text)
        text = _TEX_ENV.sub("", text)
        text = _TEX_SECTION.sub(lambda m: f"\n\n{'#' * (1 + len(m[1]) // 3)} \ue002{m[2]}\n\n", text)
        text = _TEX_GONE.sub("", text)
        text = _TEX_NOTE.sub(r" (\1)", text)
        n = 1
        while n:  # each pass takes the innermost commands and shortens the text
            text, n = _TEX_INNER.subn(r"\1", text)
        text = _TEX_QUOTED.sub(r"\1", text).replace("~", " ")
        return text.replace(sign + "\n", sign)

    def _lines(self, text: str) -> list[Block]:
        out: list[Block] = []
        # The signs of each line go apart, so that lines look as if they had none.
        signed = text.split("\n")
        signs = [{_KIND[c] for c in _SIGNS.findall(line)} if not line.isascii() else set() for line in signed]
        lines = [_SIGNS.sub("", line) if s else line for line, s in zip(signed, signs, strict=True)]
        run: list[str] = []
        held: set = set()
        i = 0

        def close() -> None:
            if run or held:
                out.append(self._inline(Block("text", "\n".join(run), set(held))))
                run.clear()
                held.clear()

        def add(kind: str, body: str, hints: set = frozenset(), sure: str = "", level: int = 0, sign: str = "") -> None:
            close()
            marks = signs[i] | ({sure} if sure else set())
            out.append(self._inline(Block(kind, body, marks, set(hints), level=level, sign=sign)))

        def deep(blanks: str) -> int:
            return len(blanks.replace("\t", "    ")) // 2

        while i < len(lines):
            line = lines[i]
            bare = line.strip()
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if not bare:
                close()
                held.update(signs[i])
                close()
            elif "\ue002" in line:
                before, body = line.split("\ue002", 1)
                add("heading", body, level=max(1, before.count("#")))
            elif (m := _WIKI_HEAD.match(line)) is not None:
                add("heading", m[2], sure="wiki", level=len(m[1]))
            elif not run and _UNDERLINE.match(after) and not _UNDERLINE.match(line) and not _LIST.match(line) and "|" not in line:
                add("heading", bare, sure="markdown", level=1 if after.startswith("=") else 2)
                i += 1
            elif (m := _MD_HEAD.match(line)) is not None and (len(line.split(" ", 1)[0]) > 1 or not after.startswith("# ")):
                # One sign before a single line: a heading, unless wiki constructs around say that it is a numbered line.
                level = len(line) - len(line.lstrip("#"))
                add("heading", m[1], {"markdown" if level > 1 else "markdown or wiki"}, sure="markdown" if level > 1 else "", level=level)
            elif _MD_RULE.match(bare) and (run or (out and out[-1].kind == "table")):
                if run:
                    head = run.pop()
                    close()
                    out.append(self._inline(Block("table", head)))
                out[-1].marks |= {"markdown"} | signs[i]
            elif bare.startswith("|") and bare.endswith("|") and len(bare) > 2:
                if _MD_RULE.match(after.strip()):
                    add("table", bare, sure="markdown")
                elif out and not run and out[-1].kind == "table":
                    more = self._inline(Block("table", bare, set(signs[i])))
                    out[-1].text += "\n" + more.text
                    out[-1].marks |= more.marks
                else:
                    add("table", bare)
            elif (m := _MD_TASK.match(line)) is not None:
                add("item", m[1], sure="markdown")
            elif _WIKI_DEEP.match(line):
                head = line[: len(line) - len(line.lstrip("*#:"))]
                add("item", _WIKI_DEEP.sub("", line), {"wiki"}, level=len(head) - 1, sign="#" if head.endswith("#") else "-")
            elif (m := _MD_QUOTE.match(line)) is not None:
                add("text", m[1], {"markdown"})
            elif (m := _LIST.match(line)) is not None:
                add("item", m[3], level=deep(m[1]), sign=m[2] if m[2][0].isdigit() else "-")
            elif _HOLD.fullmatch(bare):
                add("text", bare)
            elif _RULER.fullmatch(bare):
                close()
                held.update(signs[i])
                close()
            else:
                run.append(line)
                held.update(signs[i])
            i += 1
        close()
        return out

    def _inline(self, block: Block) -> Block:
        text, links = block.text, 0

        def link(m) -> str:
            nonlocal links
            links += len(m[2])
            return m[2]

        for needs, pattern, put in (("](", _MD_LINK, link), ("**", _MD_STRONG, r"\1"), ("__", _MD_UNDER, r"\1"), ("~~", _MD_STRIKE, r"\1"), ("*", _MD_EM, r"\1")):
            if needs not in text:
                continue
            text, n = pattern.subn(put, text)
            if n:
                block.marks.add("markdown")
        pieces = text.split("\ue003")
        links += sum(len(p) for p in pieces[1::2])
        block.text, block.links = "".join(pieces).replace("\ue002", ""), links
        return block

    def _inherit(self, blocks: list[Block]) -> None:
        # First pass: what a block itself can decide.
        for b in blocks:
            han = 0 if b.text.isascii() else len(_HAN.findall(b.text))
            length = len(b.text.strip())
            if b.kind in ("heading", "code", "formula", "table"):
                b.label = "content"
                continue
            chinese = han > len(b.text) / 3
            if chinese:
                density = sum(c in self.stop_han for c in b.text) / han
            else:
                words = _WORDS.findall(b.text.lower())
                density = sum(w in self.stop for w in words) / max(1, len(words))
            linked = b.links / max(1, length)
            if linked > 0.6 and density < 0.3:
                b.label = "residue"
            elif length >= 60 and density >= (0.03 if chinese else 0.15):
                b.label = "content"
        # Second pass: the nearest decided neighbour on either side, content where they differ or there is none. One walk down and one up.
        n = len(blocks)
        above, below = [None] * n, [None] * n
        last = None
        for i, b in enumerate(blocks):
            above[i] = last
            last = b.label or last
        last = None
        for i in range(n - 1, -1, -1):
            below[i] = last
            last = blocks[i].label or last
        for i, b in enumerate(blocks):
            if not b.label:
                b.label = "residue" if {above[i], below[i]} - {None} == {"residue"} and b.links else "content"
        # An ambiguous line takes part in the markup of its nearest marked neighbour.
        hinted = [i for i, b in enumerate(blocks) if b.hints]
        if not hinted:
            return
        near: dict[str, list] = {}
        for kind in ("markdown", "wiki"):
            best = [(n + 1, -1)] * n
            for walk in (range(n), range(n - 1, -1, -1)):
                at = None
                for i in walk:
                    if at is not None:
                        best[i] = min(best[i], (abs(i - at), at))
                    if kind in blocks[i].marks:
                        at = i
            near[kind] = best
        for i in hinted:
            b = blocks[i]
            for hint in b.hints:
                kinds = hint.split(" or ")
                distance, at = min(near[k][i] for k in kinds)
                if at >= 0:
                    b.inherited |= {k for k in kinds if near[k][i] == (distance, at)}
                elif "markdown" in kinds and b.kind == "heading":
                    b.inherited.add("markdown")
        for i in hinted:
            blocks[i].marks |= blocks[i].inherited

    def _plain(self, blocks: list[Block]) -> str:
        out: list[str] = []
        last, counts = "", {}
        for b in blocks:
            body = _BLANKS.sub(" ", b.text).strip() if b.kind not in ("code", "table") else b.text.strip("\n")
            if b.kind != "item":
                counts = {}
            if b.kind == "heading":
                body = "#" * b.level + " " + body
            elif b.kind == "item":
                sign = b.sign or "-"
                counts = {k: v for k, v in counts.items() if k <= b.level}
                if sign == "#":
                    counts[b.level] = counts.get(b.level, 0) + 1
                    sign = f"{counts[b.level]}."
                body = "  " * b.level + sign + " " + body
            elif b.kind == "code":
                body = f"```{b.sign}\n{body}\n```"
            elif b.kind == "formula":
                body = f"$ {body} $"
            tight = last == b.kind and b.kind in ("item", "table")
            out.append(("" if not out else "\n" if tight else "\n\n") + body)
            last = b.kind
        return "".join(out)


def stop_words(docs: DataFrame, text: str, language: str | None = None, share: float = 0.2, most: int = 60) -> tuple[set, set]:
    """(words, Han characters) that at least ``share`` of a language's texts hold, at most ``most`` of each language, over all texts. Texts without a language are one more language.

    Each task counts its own texts, so that only a row for each word and language of a task moves. A word with a digit is none.
    """
    label = F.lower(F.coalesce(F.substring(F.trim(F.col(language)), 1, 2), F.lit(""))) if language else F.lit("")
    rows = docs.filter(F.col(text).isNotNull()).select(label.alias("language"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def out() -> pd.DataFrame:
            flat = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(flat, columns=["language", "word", "n"])

        for batch in batches:
            for k, t in zip(batch["language"], batch["text"], strict=True):
                c = held.setdefault(k, Counter())
                low = t.lower()
                c.update({w for w in low.split() if w.isalpha() and w.isascii() or len(w) < 20 and w.isalpha() and not "一" <= w[0] <= "鿿"})
                if not low.isascii():
                    c.update({ch for ch in low if "一" <= ch <= "鿿"})
                c[""] += 1
            if sum(map(len, held.values())) > 500_000:
                yield out()
        yield out()

    counts = stored(rows.mapInPandas(count, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    total = counts.filter("word = ''").select("language", F.col("n").alias("texts"))
    # Languages are few, but their labels are dirty: those of fewer than 20 texts are left out.
    often = counts.filter("word <> ''").join(total.filter("texts >= 20"), "language").filter(F.col("n") >= F.col("texts") * share)
    best = often.withColumn("place", F.row_number().over(Window.partitionBy("language", F.length("word") == 1).orderBy(F.col("n").desc(), "word"))).filter(F.col("place") <= most)
    found = {r["word"] for r in best.select("word").distinct().collect()}  # at most 1 / share words of a language by its texts' length, and ``most``
    return {w for w in found if not "一" <= w[0] <= "鿿"}, {w for w in found if "一" <= w[0] <= "鿿"}


def clean_markup(docs: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """key, kinds (array of html, latex, markdown, wiki, sorted), text (plain), blocks, dropped (blocks of residue).

    One row in, one row out; rows with equal keys are cleaned each, rows without key are dropped. Null and blank texts give no kinds and an empty text.
    Whole texts are read, once for the corpus's stop words (by the column ``language``, if one is named) and once to clean them; other columns are not. A corpus without stop
    words, such as a very small one, takes fixed ones. Texts are dealt evenly to all tasks, which costs little beside cleaning them.
    """
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    stop, stop_han = stop_words(docs, text, language)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = Cleaner(stop or None, stop_han or None)
        for batch in batches:
            found = [clean(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "kinds": [f[0] for f in found], "text": [f[1] for f in found], "blocks": [f[2] for f in found], "dropped": [f[3] for f in found]})

    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInPandas(each, f"key {kind}, kinds array<string>, text string, blocks bigint, dropped bigint").withColumnRenamed("key", key)


def markup_kinds(cleaned: DataFrame, key: str) -> DataFrame:
    """One row per key and kind of markup that was converted."""
    return cleaned.select(key, F.explode("kinds").alias("kind")).distinct()
