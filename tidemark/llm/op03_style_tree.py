"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged branch by branch: a branch is the chain of tags with classes from the
body.  A branch carries the number of pages that have it, its presentation styles (sequences of child tags) and
its content features (texts of the blocks below).  Its importance joins the entropy of the styles and the
entropy of the features over the pages: what a host repeats alike on every page has none.  From each page the
branches of low importance go, inside an article as well.  Article and main are a prior: a branch inside needs
less importance to stay and one beside it more.  Random filler (a menu whose words differ on each page looks
important) is beyond entropy, so branches of a navigation, footer, sidebar, form, advert, notice or comment role
have importance zero.  Where a host has fewer than ``PAGES`` pages of a branch, what stands beside an article
stays only if it is an h1 or longer in all than what stands inside, and a page header goes but for its h1.

The style tree is a grouped count with one row per host, branch and feature, so a host with a third of all
pages combines in the map tasks.  Pages meet their host's low branches through a salted join; html travels
compressed.  Edge cases: null or empty html gives an empty text; a null or broken url makes one host of its
own; markup left open or never opened is closed or ignored; of repeated page ids every row is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, save, unpack

LOW = 0.2  # importance below which a branch goes
PRIOR = {"keep": 0.75, "open": 1.0, "beside": 2.0}  # factors on it: inside an article, without one, beside one
PAGES = 3  # pages a host must have of a branch before entropy speaks
GAMMA = 0.9  # weight of content against presentation
SALTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
NEVER = frozenset("head title script style noscript template iframe object svg math canvas audio video nav footer aside form button "
                  "select textarea dialog menu".split())
CONTENT = frozenset(["article", "main"])
#: Values of class, id and role attributes that mark a branch as boilerplate.
ROLES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                  "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus "
                  "navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar masthead header footer colophon comment "
                  "comments disqus respond replies reply share sharing social related recommended widget widgets search alert toast "
                  "complementary contentinfo dialog hidden skip copyright".split())
#: Containers whose ids can name a role; other ids are made from headings.
NAMED = frozenset("div ul ol table span".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
HOLDS = frozenset("ul ol dl table select tbody thead tfoot".split())


class Page(HTMLParser):
    """Blocks of a page as (branch, state, text), and the child tags of every branch.

    ``state``: "keep" inside an article, "drop" under a boilerplate role, "open" elsewhere.

    A role is a whole class, role or (of plain containers) id.  One that holds an article or main, or is one, counts
    only where the page has another of these outside such roles: comments and teasers are articles too.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack = [("", "", "open", False, ())]  # tag, branch, state, inside an article, roles around it
        self.found: list[tuple[str, str, str, tuple]] = []
        self.roles = 0
        self.doubtful: set[int] = set()  # roles that hold an article or main
        self.plain = False  # one stands outside all roles
        self.styles: dict[str, list[str]] = {}
        self.parts: list[str] = []
        self.feed(html)
        self.close()
        self._end_block()
        lifted = set() if self.plain else self.doubtful
        self.blocks = [(branch, "drop" if set(roles) - lifted else state, text) for branch, state, text, roles in self.found]

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            _, branch, state, _, roles = self._holder()
            self.found.append((branch, state, text, roles))

    def _holder(self):
        """The innermost open block element: its branch stands for the text, whatever inline tags lie between."""
        for entry in reversed(self.stack):
            if entry[0] in BLOCK or not entry[0]:
                return entry
        return self.stack[0]

    def _pop(self, index: int) -> None:
        if any(t in BLOCK for t, *_ in self.stack[index:]):
            self._end_block()
        del self.stack[index:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "p":
                    self._pop(i)
                    break
                if self.stack[i][0] in ("article", "section", "div", "table", "td", "li", "button", "body"):
                    break
        if tag in SIBLINGS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in SIBLINGS[tag]:
                    self._pop(i)
                    break
                if self.stack[i][0] in HOLDS and not (tag in ("tr",) and self.stack[i][0] in ("tbody", "thead", "tfoot")):
                    break
        if tag in BLOCK:
            self._end_block()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        known = dict(attrs)
        words = " ".join(str(known.get(k) or "") for k in ("class", "role", *(["id"] if tag in NAMED else []))).lower().split()
        _, parent, state, inside, roles = self.stack[-1]
        name = ".".join([tag, *sorted({w for w in str(known.get("class") or "").lower().split()})])
        branch = f"{parent}/{name}" if tag in BLOCK or tag in NEVER else parent
        if branch != parent:
            children = self.styles.setdefault(parent, [])
            if not children or children[-1] != name:
                children.append(name)
        hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in str(known.get("style") or "").replace(" ", "")
        role = tag not in ("body", "html") and bool(ROLES.intersection(words))
        if tag in NEVER or hidden or role and tag not in BLOCK:
            state = "drop"
        elif role:
            self.roles += 1
            roles = (*roles, self.roles)
        if state != "drop" and tag in CONTENT:
            state, inside = "keep", True
            self.doubtful.update(roles)
            self.plain |= not roles
        elif state == "keep" and known.keys() & {"class", "id", "role"} and tag in BLOCK:
            state = "open"  # a classed part of an article
        self.stack.append((tag, branch, state, inside, roles))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if self.stack[i][0] in CONTENT and tag in ("p", "b", "i", "em", "strong", "span", "a", "li"):
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1][2] != "drop":
            self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        return


def style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, branch, kind, feature): per page once each: the branch itself, its style and its content features."""
    for batch in batches:
        rows = set()
        out: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            page = Page(html or "")
            rows.clear()
            for branch, children in page.styles.items():
                rows.add((host, branch, 1, crc32("|".join(children).encode())))
            for branch, state, text in page.blocks:
                if state == "drop":
                    continue
                feature = crc32(text.encode("utf-8", "surrogatepass"))
                parts = branch.split("/")
                for i in range(2, len(parts) + 1):  # a feature counts for every branch above it
                    up = "/".join(parts[:i])
                    rows.add((host, up, 0, 0))
                    rows.add((host, up, 2, feature))
            out += rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()),
             pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int64())],
            ["host", "branch", "kind", "feature"])


def importance(pages: DataFrame) -> DataFrame:
    """(host, branch, pages, importance): the merged style tree of every host in ``pages`` (host, text).

    With m pages, a style or feature on c of them has p = c / m.  Presentation is -sum p log_m p over the styles;
    content is one less the mean of log_m c over the features, as a feature spreads evenly over its c pages.
    """
    rows = pages.select("host", "text").mapInArrow(style_rows, "host string, branch string, kind int, feature long")
    counts = rows.groupBy("host", "branch", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    of = lambda k, v: F.when(F.col("kind") == k, v)
    c = F.col("c").cast("double")
    tree = counts.groupBy("host", "branch").agg(
        F.coalesce(F.max(of(0, c)), F.lit(0.0)).alias("m"), F.sum(of(1, c)).alias("styled"),
        F.sum(of(1, c * F.log(c))).alias("style_sum"), F.avg(of(2, F.log(c))).alias("spread"))
    log_m = F.log("m")
    shape = F.when(F.col("styled") > 1, (F.log("styled") - F.col("style_sum") / F.col("styled")) / F.log("styled")).otherwise(1.0)
    value = F.when(F.col("m") > 1, (1 - GAMMA) * F.coalesce(shape, F.lit(0.0)) + GAMMA * (1 - F.coalesce(F.col("spread"), F.lit(0.0)) / log_m))
    return tree.select("host", "branch", F.col("m").cast("long").alias("pages"), F.coalesce(value, F.lit(1.0)).alias("importance"))


def main_text(html: str | None, tree: dict[str, float], low: float = LOW) -> str:
    """The page without boilerplate roles and branches of low importance; ``tree`` has those that the host has enough pages of."""
    page = Page(html or "")
    blocks = [b for b in page.blocks if b[1] != "drop"]
    holds = re.compile(rf"/(?:{'|'.join(sorted(CONTENT))})(?=[./]|$)")
    within = [bool(holds.search(branch)) for branch, _, _ in blocks]
    size = [sum(len(b[2]) for b, w in zip(blocks, within) if w == side) for side in (True, False)]
    kept = []
    for (branch, state, text), inside in zip(blocks, within):
        beside = any(within) and not inside
        parts = branch.split("/")
        masthead = not inside and any(p.split(".")[0] == "header" for p in parts)
        if branch not in tree and parts[-1].split(".")[0] != "h1" and (masthead or beside and size[0] >= size[1]):
            continue
        least = low * PRIOR["beside" if beside else state]
        if tree.get(branch, 1.0) < least or any(tree.get("/".join(parts[:i]), 1.0) < min(low, least) for i in range(2, len(parts))):
            continue
        kept.append(text)
    return "\n".join(kept)


def _extracted(low: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(unpack(b).decode("utf-8", "replace"), {e["branch"]: e["importance"] for e in tree or ()}, low)
                     for b, tree in zip(batch.column("blob").to_pylist(), batch.column("tree").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    sited = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("text"))
    tree = save(importance(sited), "op03-tree")
    known = tree.filter(F.col("pages") >= least_pages).groupBy("host").agg(
        F.collect_list(F.struct("branch", "importance")).alias("tree"))  # branches of one host: its templates, not its pages
    salted = packed(sited.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "blob", "tree")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extracted(low), f"page_id {kind}, url string, text string, n_chars long")
