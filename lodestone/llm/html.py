"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; what sits in menus, headers, footers, sidebars, forms,
notices, adverts, scripts and reader comments is left out on the way. Over the lines' text lengths (link texts
count for nothing) sums of sliding windows are taken; the text surges where a window's sum rises above a threshold and
dives where the sums fall back to nothing. The heaviest of these runs is the core; runs before and behind it that only
links, headings and short lines part from it belong to it. The lines from first surge to last dive are the text.

Markup settles its two ends only. Where most of the core lies in an article or main element, lines of other elements at the ends go,
and the text goes on over the element's own lines until it dives there too: GAP lines in a row without text; articles inside
the element whose part of all runs is below the threshold are left out. Otherwise headings just before the first surge are added. On a
page of little text the threshold is what its greatest window has; a page whose windows are all empty has no text.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Lines of a window, the characters that a window's sum must reach for a surge, and the lines between runs that are joined.
WINDOW, SURGE, GAP = 3, 86, 12

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form button select svg canvas object audio video map dialog menu".split())
NESTED = frozenset("article main div section aside nav header footer form table ul ol dl dialog menu head body blockquote figure button select svg canvas object audio video map fieldset details".split())
ENDED = frozenset("p h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
NAMES = READERS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search social share sharing related recommended recommendations widget widgets pagination pager toolbar copyright".split()
)
#: Words that say nothing of what an element with one of the NAMES is, and those that only say what goes with it.
FILLER = frozenset("box block links list bar area section container wrapper inner outer posts post stories items item site page top bottom left right main".split())
GOES_WITH = ("has-", "no-", "with-", "without-", "is-")

SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)([^>\"']*)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-zA-Z]+")
SPACE = re.compile(r"\s+")


class Page:
    """Lines of one page: (text, characters outside links, container number, heading?)."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, int, bool]] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # element, dropped?, by readers?, container
        self.count: Counter[str] = Counter()  # elements on the stack, by name
        self.kinds: list[str] = [""]  # containers: article, main, or none for 0
        self.top: list[int] = [0]  # the container that each lies in, or itself
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = False
        self.heading = False
        self._read(source)

    def _state(self):
        return self.stack[-1][1:] if self.stack else (False, False, 0)

    def _push(self, *entry) -> None:
        self.stack.append(entry)
        self.count[entry[0]] += 1

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        return name

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                self.lines.append((text, max(0, len(text) - self.linked), self._state()[2], self.heading))
        self.parts, self.linked = [], 0

    def _text(self, text: str) -> None:
        if text and not self._state()[0]:
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    @staticmethod
    def _left_out(name: str, key: str, token: str, names: frozenset[str], container: int) -> bool:
        """Whether a class or id says that an element is no text. A heading's or paragraph's id is an anchor; inside an article
        or main element a class must say nothing else, and an id must be of readers' comments."""
        words = [w for w in SPLIT.split(token) if w]
        if not any(w in names for w in words) or key == "id" and name in ENDED:
            return False
        if container or name in ENDED:
            known = names if key == "class" else READERS - {"discussion"}
            return any(w in known for w in words) and all(w in known or w in NAMES and key == "class" or w in FILLER for w in words)
        return True

    def _open(self, name: str, attrs: str) -> None:
        dropped, readers, container = self._state()
        named: list[tuple[str, str]] = []
        hidden = False
        if attrs.strip(" /"):
            for m in ATTR.finditer(attrs):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    named += [(key, token) for token in value.lower().split() if not token.startswith(GOES_WITH)]
                elif key == "role":
                    hidden |= value.lower() in ROLES
                    name = "main" if value.lower() == "main" else name
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
        own = name not in ("html", "body", "main") and any(self._left_out(name, key, token, NAMES, container) for key, token in named)
        by = readers or name not in ("html", "body") and any(self._left_out(name, key, token, READERS, container) for key, token in named)
        if name in ("article", "main") and not by and not hidden and not any(self.count[n] for n in DROPPED):
            if self.kinds[container] != "article":
                self.kinds.append(name)
                self.top.append(container if container and not dropped else len(self.top))
                container = len(self.kinds) - 1
            dropped = False
        else:
            dropped = dropped or hidden or own or name in DROPPED or name == "header" and container == 0
        self._push(name, dropped, by, container)

    def _tag(self, closing: str, name: str, attrs: str) -> None:
        if name in BLOCKS or name in NESTED:
            self._flush()
            self.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closing
            self.in_link = False
        elif name == "a":
            self.in_link = not closing
        elif name in ("br", "img", "input", "wbr"):
            self._text(" " if name == "br" else "")
        if name == "body" and not closing and self.count["head"]:  # a body ends a head that was left open
            while self._pop() != "head":
                pass
        if name in ("br", "hr", "img", "input", "meta", "link", "wbr", "html", "source", "area", "col", "embed", "base"):
            return
        if not closing and name in BLOCKS and self.stack and self.stack[-1][0] not in NESTED and (self.stack[-1][0] in ENDED or self.stack[-1][0] == name):
            self._pop()  # the next block ends a paragraph or item that was left open
        if not closing:
            if attrs.rstrip().endswith("/"):
                return
            if name in NESTED:
                self._open(name, attrs)
            elif attrs:
                self._open(name, attrs)
                if not self.stack[-1][1] or self.stack[-1][0] != name:
                    self._pop()  # only elements that hold others, or whose text is left out, are kept track of
        elif self.count[name]:
            while self._pop() != name:
                pass
        elif name in ("section", "div") and self.stack and self.stack[-1][0] == "main":
            self._pop()  # an element that its role made main

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        odd_quotes: set[str] = set()
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                break
            self._text(s[at:lt])
            m = SIMPLE.match(s, lt)
            if m:
                closing, name, attrs, at = m[1], m[2].lower(), m[3], m.end()
            elif s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            elif s.startswith(("<!", "<?"), lt):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            else:
                name_at = NAME.match(s, lt)
                if not name_at:
                    self._text("<")
                    at = lt + 1
                    continue
                end = self._tag_end(s, name_at.end(), odd_quotes)
                if end < 0:  # cut off inside a tag
                    break
                closing, name, attrs, at = s[lt + 1] == "/" and "/" or "", name_at[1].lower(), s[name_at.end() : end], end + 1
            if name in RAW and not closing:
                end = re.compile(f"</{name}", re.I).search(s, at)
                if not end:
                    break
                gt = s.find(">", end.end())
                at = n if gt < 0 else gt + 1
                continue
            self._tag(closing, name, attrs)
        self._flush()

    @staticmethod
    def _tag_end(s: str, at: int, odd: set[str]) -> int:
        """Where the tag's ``>`` is; quoted values may hold one. A quote never closed again counts as a letter."""
        while True:
            gt = s.find(">", at)
            if gt < 0:
                return -1
            quotes = [q for q in (s.find(c, at, gt) for c in "\"'" if c not in odd) if q >= 0]
            if not quotes:
                return gt
            q = min(quotes)
            if not s[at:q].rstrip().endswith("=") and not s[max(0, q - 8) : q].rstrip().endswith("="):
                at = q + 1
                continue
            close = s.find(s[q], q + 1)
            if close < 0:
                odd.add(s[q])
                continue
            at = close + 1

    def threshold(self) -> int:
        """What a window's sum must reach: SURGE, or on a page of little text, what its greatest window has."""
        size = [x[1] for x in self.lines]
        return max(1, min(SURGE, max((sum(size[i : i + WINDOW]) for i in range(len(size))), default=0)))

    def runs(self) -> list[tuple[int, int]]:
        """Where the text surges and dives: [first line, line after the last)."""
        size = [x[1] for x in self.lines]
        total = [0, *itertools.accumulate(size)]
        at = lambda i: total[min(max(i, 0), len(size))]
        ahead = [at(i + WINDOW) - at(i) for i in range(len(size))]  # the window that begins at a line
        behind = [at(i + 1) - at(i + 1 - WINDOW) for i in range(len(size))]  # the window that ends there
        found, i, surge = [], 0, self.threshold()
        while i < len(size):
            if ahead[i] >= surge and size[i] > 0:
                j = i + 1
                while j < len(size) and ahead[j] > 0 and size[j] + behind[j] > 0:
                    j += 1
                found.append((i, j))
                i = j
            else:
                i += 1
        return found

    def text_between(self) -> tuple[int, int, list[tuple[int, int]], tuple[int, int]]:
        """First surge and last dive of the text, all runs, and the core: the heaviest run, with those that only links, headings and short lines part from it."""
        runs = self.runs()
        if not runs:
            return 0, 0, runs, (0, 0)
        core = max(range(len(runs)), key=lambda k: (sum(x[1] for x in self.lines[slice(*runs[k])]), -k))
        first = last = core
        while first and self._joined(runs[first - 1][1], runs[first][0]):
            first -= 1
        while last + 1 < len(runs) and self._joined(runs[last][1], runs[last + 1][0]):
            last += 1
        return runs[first][0], runs[last][1], runs, runs[core]

    def main_text(self) -> str:
        """The lines between first surge and last dive, with both ends settled by markup."""
        lines = self.lines
        a, b, runs, core = self.text_between()
        if a == b:
            return ""
        inside: Counter[int] = Counter()
        for _, chars, container, _ in lines[slice(*core)]:
            inside[self.top[container]] += chars
        home = max(inside, key=lambda c: (inside[c], c))
        if not home:
            while lines[a][2]:  # a window reaches over the end of an element that has not the core
                a += 1
            while lines[b - 1][2]:
                b -= 1
            while a > 0 and lines[a - 1][3] and not lines[a - 1][2]:
                a -= 1
            return "\n".join(x[0] for x in lines[a:b])
        own = lambda i: self.top[lines[i][2]] == home
        while not own(a):
            a += 1
        while not own(b - 1):
            b -= 1
        a, b = self._on(a, -1, own), self._on(b - 1, 1, own) + 1
        held: Counter[int] = Counter()
        for run in runs:
            for _, chars, container, _ in lines[slice(*run)]:
                held[container] += chars
        surge = self.threshold()
        return "\n".join(x[0] for i, x in enumerate(lines[a:b], a) if own(i) and (x[2] == home or held[x[2]] >= surge))

    def _on(self, end: int, step: int, own) -> int:
        """The last line that its element adds at an end of the text: on over the element's lines, until GAP of them in a row have no text outside links."""
        i, bare = end + step, 0
        while 0 <= i < len(self.lines) and own(i):
            bare = 0 if self.lines[i][1] else bare + 1
            if bare > GAP:
                break
            i += step
        return i - step

    def _joined(self, a: int, b: int) -> bool:
        """Whether the lines [a, b) between two runs leave them together."""
        return b - a <= GAP and all(x[3] or x[1] < SURGE // WINDOW for x in self.lines[a:b])


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if there is none), n_chars.

    Defined cases: null and empty html give an empty text; markup that is cut off or nested wrongly is read as
    far as it goes; rows are independent, so ties, nulls in other columns and repeated rows do not matter; an
    empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidy(run), schema)
