"""Main text of web pages by equivalence-class template deduction.

A token is a tag or a text node with its role: the path of block elements (names and class words) that
it stands in. Elements that a page leaves open are closed where their parent ends. Tokens of a host with
the same occurrence vector (how often each comes in each of the host's pages) form an equivalence class.
A second pass over the pages validates the classes that half of the host's pages or more have: a tag that
stands anywhere but at its turn in its class, or whose class lies in different gaps of the class around
it, is left out; two valid tags at least make a class. Valid classes, nested gap in gap, are the template.

The template decides the slots that are text. From the outermost element that comes once a page it goes
down to the child with over half of the varying text outside links, as long as that leaves links,
constant or vetoed text behind (a heading beside the text stays). That element is the host's container;
its slots are the text. Not taken are text nodes that all pages have in the same gap (unless they
outweigh the varying text: then the pages are copies of each other), repeated slots that are links for
the most part, and what element names or class words veto: names decide nothing else. Class words that parts of an
article have, too (header, legal and the like), veto neither there nor within an article or main element.

Pages of hosts with fewer than three pages, and pages without their host's container, have no template.
There, names decide: the article or main element if there is one, else what is neither vetoed nor links.

Occurrence vectors are never gathered: tasks add up hashes of (page, count) for each host and token, so
a host of a third of all pages is a few sums for each token. A template is as large as twice a page.

Null html: as an empty page. Null or empty url: a host of its own. Equal pages of a host get equal texts.
Broken markup (unclosed elements, comments or scripts) is read to the page's end. An empty table of pages
gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

#: Bytes of templates, of all hosts together, up to which they are broadcast; beyond, pages are joined to them.
BROADCAST_BYTES = 32 << 20
# text, or a tag without `<` in it; nothing is tried twice
_simple = re.compile(r"[^<]++|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_name = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_stop = re.compile(r"[>\"']")
_RAW = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "head")}
_attr = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "ul", "ol", "section", "article"}
_BOILER = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "title"}
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|comments?|disqus|replies|respond|sidebar|menu|nav\w*|breadcrumbs?|share|sharing|social|related|recommend\w*|subscri\w*|newsletter|popup|modal|footer|masthead|topbar|toolbar|login|pag(?:er|ination)|skip)(?:$|[\s_-])", re.I)
#: Class words that parts of an article have, too.
_DOUBT = re.compile(r"(?:^|[\s_-])(?:alert|side|widget|header|search|copyright|legal)(?:$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|maincontent|post|entry|story)(?:[\s_-](?:body|content|text))?(?:$|\s)", re.I)
_HEADINGS = {"h1", "h2", "h3", "p"}
TEXT, OPEN, CLOSE = 0, 1, 2
_END = 0x2545F4914F6CDD1D  # turns the key of an element's begin into that of its end


class Token(NamedTuple):
    """key: the role (0: white space, or an inline element); owner: the role of the block element around
    it. linked, main: inside a link, an article or main element. veto: inside a vetoed element (2), or one that is
    vetoed unless a template's container holds it (1). plain: an element of headings or paragraphs."""

    kind: int
    key: int
    owner: int
    text: str = ""
    linked: bool = False
    veto: int = 0
    main: bool = False
    plain: bool = False


def _key(text: str, seed: int = 11) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


_roles: dict[tuple, tuple[int, int, bool]] = {}


def _role(path: int, name: str, attributes: str, in_main: bool) -> tuple[int, int, bool]:
    """Role of an element in `path`, its veto (Token), and whether it is a main element."""
    asked = (path, name, attributes, in_main)
    if (got := _roles.get(asked)) is None:
        if len(_roles) > 50_000:
            _roles.clear()
        hint = " ".join((a[1] or a[2] or a[3]) for a in _attr.findall(attributes)) if attributes else ""
        sign = " ".join(w for w in hint.split() if not re.search(r"\d{3}", w))
        main = name in ("article", "main") or (name in ("div", "section") and bool(_MAIN.search(hint)))
        named = bool(hint) and name not in ("html", "body", "article", "main")
        veto = 2 if name in _BOILER or (named and _HINT.search(hint)) else int(not in_main and (name == "header" or (named and bool(_DOUBT.search(hint)))))
        got = _roles[asked] = (_key(f"{name} {sign}", path), veto, main)
    return got


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """Name (of an end tag with a slash before it), attributes and '' of each tag, or '', '' and text; comments and raw
    elements are left out. A tag ends at the first `>` outside of quotes; a `<` without such an end is text. Each
    character is looked at a few times, however the page is broken: where a quote of a tag leads is kept."""
    at, n, last, leads, near = 0, len(page), page.rfind(">"), {}, (0, -1)

    def end_of(p: int) -> int:
        """The end of a tag whose attributes begin at p, or -1. p grows from call to call."""
        nonlocal near
        if not near[0] <= p <= near[1]:
            m = _stop.search(page, p)
            near = p, m.start() if m else n
        stop, trail = near[1], []
        while stop < n and page[stop] != ">" and stop not in leads:
            trail.append(stop)
            close = page.find(page[stop], stop + 1)
            m = _stop.search(page, close + 1) if close >= 0 else None
            stop = m.start() if m else n
        found = leads.get(stop, stop if stop < n else -1)
        leads.update(dict.fromkeys(trail, found))
        return found

    while at < n:
        m = _simple.match(page, at)
        if m and not m[2]:
            yield "", "", m[0]
            at = m.end()
            continue
        if m and (m[1] or m[2].lower() not in _RAW):
            yield m[1] + m[2].lower(), m[3], ""
            at = m.end()
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if at < last:
            if m := _name.match(page, at):
                name = m[2].lower()
                if not m[1] and name in _RAW:
                    m = _RAW[name].search(page, page.find(">", at) + 1)
                    at = m.end() if m else n
                    continue
                if (end := end_of(m.end())) >= 0:
                    yield m[1] + name, page[m.end() : end], ""
                    at = end + 1
                    continue
            elif page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
        yield "", "", "<"
        at += 1


def tokens(page: str | None) -> list[Token]:
    """Tags of block elements and text nodes of a page, each element with its end; comments, scripts,
    styles and the head are left out. Line breaks are white space."""
    out: list[Token] = []
    # name, role and state outside of each open element: path, linked, veto, main
    stack: list[tuple[str, int, int, bool, int, bool]] = []
    open_: Counter = Counter()
    path, linked, veto, main = 0, False, 0, False

    def end() -> None:
        nonlocal path, linked, veto, main
        name, key, path, linked, veto, main = stack.pop()
        open_[name] -= 1
        if key:
            out.append(Token(CLOSE, key ^ _END, key))

    for name, attributes, shown in pieces(page or ""):
        if shown:
            shown = html.unescape(shown)
            out.append(Token(TEXT, 0 if shown.isspace() else _key(" ".join(shown.split()), path ^ 1), path, shown, linked, veto, main))
        elif name[0] == "/":
            if open_[name[1:]]:
                while stack[-1][0] != name[1:]:
                    end()
                end()
        elif name == "br":
            out.append(Token(TEXT, 0, path, " ", linked, veto, main))
        elif name not in _VOID:
            if name in _CLOSES:
                while stack and (stack[-1][0] in _INLINE or stack[-1][0] == "p" or (name == "li" and stack[-1][0] == "li")):
                    end()
            key, own, is_main = _role(path, name, attributes, main)
            inline = name in _INLINE
            stack.append((name, 0 if inline else key, path, linked, veto, main))
            open_[name] += 1
            linked, veto, main = linked or name == "a", max(veto, own), main or is_main
            if not inline:
                out.append(Token(OPEN, key, path, "", linked, veto, main, name in _HEADINGS))
                path = key
    while stack:
        end()
    return out


def host(url: str | None) -> str:
    return re.sub(r"^www\.", "", re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip(), flags=re.I).split("/")[0].split("?")[0].lower())


class Row(NamedTuple):
    """A token of half of a host's pages or more. a, b: hashes of its occurrence vector. times: how often
    it comes in all; place: its mean first place; chars, linked: code points of its own text, and of
    those in links; state: kind, and 4 if vetoed, 8 if plain, 16 if vetoed in containers, too."""

    token: int
    pages: int
    a: int
    b: int
    times: int
    place: float
    chars: int
    linked: int
    owner: int
    state: int


@dataclass
class Classes:
    """Candidates: at[tag]: its class and its turn in it; size[class]; texts: text nodes of all pages."""

    at: dict[int, tuple[int, int]] = field(default_factory=dict)
    size: dict[int, int] = field(default_factory=dict)
    texts: set[int] = field(default_factory=set)


@dataclass
class Template:
    """at: tags of valid classes; parent: of each class the class and gap around it, hashed; container:
    the element that holds the text (0: none, the whole page is one slot); drop: elements in it whose own
    text goes; constant: text nodes that all pages have in one place."""

    at: dict[int, tuple[int, int]] = field(default_factory=dict)
    parent: dict[int, int] = field(default_factory=dict)
    container: int = 0
    drop: set[int] = field(default_factory=set)
    constant: set[int] = field(default_factory=set)


def candidates(rows: list[Row], pages: int) -> Classes:
    """Tags of equal occurrence vectors, in order of their mean place. A class is named by its first tag."""
    out = Classes()
    if pages < 3:
        return out
    groups: dict[tuple, list] = {}
    for r in rows:
        if r.state & 3 == TEXT:
            if r.times == r.pages == pages:
                out.texts.add(r.token)
        else:
            groups.setdefault((r.pages, r.a, r.b), []).append((r.place, r.token))
    for members in groups.values():
        if len(members) > 1:
            members.sort()
            name = members[0][1]
            out.size[name] = len(members)
            out.at |= {token: (name, i) for i, (_, token) in enumerate(members)}
    return out


def gap(name: int, turn: int) -> int:
    """The gap after a class's tag, as one number."""
    return _key(f"{name} {turn}")


def check(toks: list[Token], classes: Classes) -> Iterator[tuple[int, bool, int]]:
    """For each candidate token of a page whether it is out of turn, and the gap that its class (or the
    text node) lies in, 0 on the outermost level."""
    open_: list[list[int]] = []  # class, the tag last seen
    for t in toks:
        if t.kind == TEXT:
            if t.key in classes.texts:
                yield t.key, False, gap(*open_[-1]) if open_ else 0
            continue
        got = classes.at.get(t.key)
        if got is None:
            continue
        name, turn = got
        wrong = False
        if not any(o[0] == name for o in open_):
            around, wrong = (gap(*open_[-1]) if open_ else 0), turn != 0
            open_.append([name, turn])
        else:
            while open_[-1][0] != name:  # a class that begins in a gap must end there
                open_.pop()
                wrong = True
            wrong |= open_[-1][1] + 1 != turn
            open_[-1][1] = turn
            around = gap(*open_[-2]) if len(open_) > 1 else 0
        if turn == classes.size[name] - 1:
            open_.pop()
        yield t.key, wrong, around


def deduce(rows: list[Row], pages: int, checks: dict[int, tuple[int, int, int]]) -> Template:
    """checks[token]: how often it was out of turn, and the least and the greatest gap it was found in."""
    classes, out = candidates(rows, pages), Template()
    members: dict[int, list[int]] = defaultdict(list)
    for token, (name, _) in classes.at.items():
        wrong, low, high = checks.get(token, (1, 0, 0))
        if not wrong and low == high:
            members[name].append(token)
    for name, some in members.items():
        around = Counter(checks[t][1] for t in some).most_common(1)[0][0]
        some = [t for t in some if checks[t][1] == around]
        if len(some) > 1:
            out.parent[name] = around
            out.at |= {t: classes.at[t] for t in some}
    constant = {t for t in classes.texts if (c := checks.get(t)) and not c[0] and c[1] == c[2]}
    by = {r.token: r for r in rows}
    of: dict[int, list[int]] = defaultdict(list)
    for r in rows:
        if r.state & 3 == OPEN:
            of[r.owner].append(r.token)
    fixed: Counter = Counter()
    for t in constant:
        fixed[by[t].owner] += by[t].chars
    #: elements of valid classes that come once in a page
    once = {t for t in out.at if t ^ _END in out.at and by[t].state & 3 == OPEN and by[t].times == by[t].pages}

    def below(t: int) -> list[int]:
        out = [t]
        for x in out:
            out += of[x]
        return out

    def worth(t: int) -> int:
        r = by[t]
        return max(0, r.chars - fixed[t] - r.linked) if not r.state & 4 else 0

    def odd(t: int) -> bool:
        """Whether an element's own text is other than headings or paragraphs of the pages' own words."""
        r = by[t]
        return r.chars > 0 and (bool(r.state & 4) or not r.state & 8 or 2 * r.linked >= r.chars or 2 * fixed[t] >= r.chars)

    value: dict[int, int] = {}
    for top in [r.token for r in rows if r.state & 3 == OPEN and r.owner not in by]:
        for t in reversed(below(top)):  # children come after their parents
            value[t] = worth(t) + sum(value[c] for c in of[t])
    tops = [t for t in once if not any(t in of[p] for p in once)]
    at = max(tops, key=lambda t: (value.get(t, 0), -by[t].place), default=0)
    while at:
        best = max((c for c in of[at] if c in once), key=lambda c: value[c], default=0)
        if not best or 2 * value[best] <= value[at]:
            break
        inner = set(below(best))
        left = [t for t in below(at) if t not in inner and by[t].chars]
        if left and not any(map(odd, left)):
            break
        at = best
    if not at or not value[at]:
        # all pages are copies of each other: what all have is no template's
        if not at or not constant:
            return out
        return deduce([r for r in rows if r.token not in constant], pages, checks)
    out.container = at
    inner = below(at)
    varying = sum(by[t].chars - fixed[t] for t in inner)
    if sum(fixed[t] for t in inner) <= varying:
        out.constant = {t for t in constant if by[t].owner in set(inner)}
    out.drop = {t for t in inner if by[t].state & 16 or (by[t].times > by[t].pages and by[t].chars and 2 * by[t].linked >= by[t].chars)}
    return out


class _Blocks:
    """Text nodes, put together to blocks; white space in and around a block is one space or none."""

    def __init__(self) -> None:
        self.now: list[str] = []
        self.out: list[str] = []
        self.size = self.linked = 0

    def add(self, t: Token) -> None:
        self.now.append(t.text)
        if t.key:
            self.size += len(t.text)
            self.linked += len(t.text) * t.linked

    def end(self, links: bool = True) -> None:
        """links: whether a block of links for the most part is kept."""
        if self.now and (links or 2 * self.linked < self.size) and (x := " ".join("".join(self.now).split())):
            self.out.append(x)
        self.now, self.size, self.linked = [], 0, 0


def main_text(page: str | None, template: Template) -> str | None:
    """The text of the template's slots; None if the page doesn't have the container."""
    inside, seen, out = not template.container, not template.container, _Blocks()
    for t in tokens(page):
        if t.kind != TEXT:
            out.end()
            if t.kind == OPEN and t.key == template.container:
                inside = seen = True
            elif t.kind == CLOSE and t.owner == template.container:
                inside = False
        elif inside and (not template.container or not (t.veto > 1 or t.owner in template.drop or t.key in template.constant)):
            out.add(t)
    out.end()
    return " ".join(out.out) if seen else None


def lone_text(page: str | None) -> str:
    """The text of a page without template, by names and links alone."""
    toks = tokens(page)
    central, out = any(t.main for t in toks), _Blocks()
    for t in toks:
        if t.kind != TEXT:
            out.end(links=central)
        elif not t.veto and (t.main or not central):
            out.add(t)
    out.end(links=central)
    return " ".join(out.out)


def text_of(page: str | None, template: Template | None) -> str:
    found = main_text(page, template) if template is not None and template.container else None
    return lone_text(page) if found is None else found


_SUMS = ["pages", "a", "b", "times", "place", "chars", "linked"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, pages in slices(batch, "html", 4_000_000):
            held: dict[tuple[int, int], list[int]] = {}
            for url, page in zip(part.column(0).to_pylist(), pages, strict=True):
                h, mark = _key(host(url)), _key(page or "")
                seen: dict[int, list[int]] = {0: [1, 0, 0, 0, 0, 0]}  # times, place, chars, linked, owner, state
                for i, t in enumerate(tokens(page)):
                    if t.kind == TEXT and t.key and (own := seen.get(t.owner)) and t.owner:
                        own[2] += len(t.text)
                        own[3] += len(t.text) * t.linked
                    if t.key:
                        got = seen.get(t.key)
                        if got is None:
                            got = seen[t.key] = [0, i, 0, 0, t.owner, t.kind | 4 * (t.veto > 0) | 8 * t.plain | 16 * (t.veto > 1)]
                        got[0] += 1
                        got[2] += len(t.text)
                for k, (n, *rest) in seen.items():
                    v = (mark ^ n * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                    v ^= v >> 31
                    got = held.setdefault((h, k), [0, 0, 0, 0, 0, 0, 0, rest[3], rest[4]])
                    for j, x in enumerate((1, v & 0x3FFFFFFF, v >> 30 & 0x3FFFFFFF, n, *rest[:3])):
                        got[j] += x
            arrays = [pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(9))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "token", *_SUMS, "owner", "state"])


def templates(pages: DataFrame) -> DataFrame:
    """host (a hash), n (its pages), and rows: the tokens that half of the host's pages or more have."""
    counted = pages.select("url", "html").mapInArrow(_counted, "host long, token long, " + ", ".join(f"{c} long" for c in (*_SUMS, "owner", "state")))
    each = counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("owner").alias("owner"), F.max("state").alias("state"))
    often = written(each.where("pages > 2"))
    sizes = often.where("token = 0").select("host", F.col("pages").alias("n"))
    row = F.struct("token", "pages", "a", "b", "times", (F.col("place") / F.col("pages")).alias("place"), "chars", "linked", "owner", "state")
    return often.where("token <> 0").join(sizes, "host").where("2 * pages >= n").groupBy("host").agg(F.first("n").alias("n"), F.collect_list(row).alias("rows"))


def _with_hosts(pages: DataFrame, keep: list[str], table: DataFrame, size: int, made: Callable, run: Callable, schema) -> DataFrame:
    """Each slice of pages (the columns in `keep`, url and html), their html, hosts and what `made` makes
    of their hosts' rows of `table` (None if there is none) through `run`, which gives a RecordBatch.
    `size`: the bytes of the table, by which it is broadcast or joined."""
    narrow = pages.select(*keep, F.col("url").alias("__url"), F.col("html").alias("__html"))
    k = len(keep)
    hosts_of = lambda part: [_key(host(u)) for u in part.column(k).to_pylist()]
    if size <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: made(r) for r in table.collect()})

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, htmls in slices(batch, "__html", 4_000_000):
                    hosts = hosts_of(part)
                    yield run(part, htmls, hosts, [sent.value.get(h) for h in hosts])

        return narrow.mapInArrow(flat, schema)

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts_of(batch), pa.int64())], names=[*batch.schema.names, "__host"])

    names = [c for c in table.columns if c != "host"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part, htmls in slices(batch, "__html", 4_000_000):
                hosts, out = part.column(k + 2).to_pylist(), []
                for i, h in enumerate(hosts):
                    if h != last[0]:
                        row = {c: part.column(k + 3 + j)[i].as_py() for j, c in enumerate(names)}
                        last = (h, None if row["rows"] is None else made(row))
                    out.append(last[1])
                yield run(part, htmls, hosts, out)

    keyed = narrow.mapInArrow(with_host, T.StructType([*narrow.schema.fields, T.StructField("__host", T.LongType())]))
    named = table.select(F.col("host").alias("__host"), *(F.col(c).alias(f"__{c}") for c in names))
    return keyed.join(named, "__host", "left").select(*narrow.columns, "__host", *(f"__{c}" for c in names)).mapInArrow(joined, schema)


def _rows(held) -> list[Row]:
    return [Row(*(r.values() if isinstance(r, dict) else r)) for r in held]


def _checked(part: pa.RecordBatch, htmls: list, hosts: list, classes: list) -> pa.RecordBatch:
    held: dict[tuple[int, int], list[int]] = {}
    for page, h, some in zip(htmls, hosts, classes, strict=True):
        if some is not None and (some.at or some.texts):
            for token, wrong, around in check(tokens(page), some):
                got = held.setdefault((h, token), [0, around, around])
                got[0] += wrong
                got[1], got[2] = min(got[1], around), max(got[2], around)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(3))], names=["host", "token", "wrong", "low", "high"])


def learned(pages: DataFrame) -> tuple[DataFrame, int]:
    """host, n, rows and checks of each host of three pages or more, and the bytes of that."""
    found = written(templates(pages))
    size = found.agg(F.sum(100 * F.size("rows") + 64)).first()[0] or 0
    checked = _with_hosts(pages, [], found, size, lambda r: candidates(_rows(r["rows"]), r["n"]), _checked, "host long, token long, wrong long, low long, high long")
    each = checked.groupBy("host", "token").agg(F.sum("wrong").alias("wrong"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = each.groupBy("host").agg(F.collect_list(F.struct("token", "wrong", "low", "high")).alias("checks"))
    return written(found.join(held, "host", "left")), 2 * size


def template_of(row) -> Template:
    return deduce(_rows(row["rows"]), row["n"], {c["token"]: (c["wrong"], c["low"], c["high"]) for c in row["checks"] or []})


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep`, text (empty if none) and n_chars."""
    names = [c for c in keep if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    table, size = learned(pages)

    def run(part: pa.RecordBatch, htmls: list, hosts: list, found: list) -> pa.RecordBatch:
        out = [text_of(p, t) for p, t in zip(htmls, found, strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=schema.names)

    return _with_hosts(pages, names, table, size, template_of, run, schema)
