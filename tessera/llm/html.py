"""Main-text extraction by consensus host paths.

Every page scores its containers by the text of the blocks in them and casts votes for their
generalised tag-class paths. Spark sums the votes by host and path; the path with the most votes
wins its host. Pages are then extracted again: the elements at the winning path give the text, or,
where a page has none, its own best container.

Cases: null html is empty and gives an empty text; a page without a host uses its own best
container; unclosed tags, truncated markup and stray end tags are tolerated; equal rows get equal
texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, small_batches, stage

#: Elements whose content is never text of an article. Fixed values.
SKIPPED = frozenset("head title script style noscript template iframe object svg math canvas nav header footer aside form button select option textarea input menu dialog audio video map".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body div main section td center blockquote html".split())
#: Words of class, id or role that mark page furniture. Fixed values.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that tell what a page is laid out with, and words that say nothing in an id. Fixed values.
LAYOUT = frozenset("with has no without".split())
FILLERS = frozenset("area block box container inner list section wrap wrapper".split())
#: Furniture that an article may hold. Fixed values.
FOREIGN = frozenset("ad ads adv advert adverts advertisement comment comments cookie cookies disqus newsletter promo replies respond share sharing sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("div section ul ol dl table main article".split())
#: A start tag of the key closes an open element of the value, up to a table or list around it.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
} | dict.fromkeys(BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, ("p",))
FENCES = frozenset("table ul ol dl div article section main blockquote body html".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks_furniture(name: str) -> bool:
    """Whether one class names page furniture; what a page has, or has not, is no name of it."""
    words = [w.lower() for w in PIECES.findall(name)]
    return not FURNITURE.isdisjoint(words) and LAYOUT.isdisjoint(words)


def step_of(tag: str, attributes: str, in_article: bool = False) -> tuple[str, bool]:
    """Generalised step of a path (tag and class words, numbers dropped), and whether the element is page furniture.

    Classes and roles count on all elements but headings and the page itself. An id is a place's name as often as
    a part's: it counts only on containers and lists, only if all its words are furniture, and in an article
    only if they are adverts, notices or comments. An article's own header is its title.
    """
    marks = tag in SKIPPED and not (tag == "header" and in_article)
    if not attributes or "=" not in attributes:
        return tag, marks
    classes, plain = [], tag in ("html", "body") or tag in HEADINGS
    for m in ATTRIBUTE.finditer(attributes):
        value, kind = m[2] or m[3] or m[4] or "", m[1].lower()
        if kind == "class":
            classes += [re.sub(r"[0-9]+", "", c.lower()) for c in value.split()]
        if plain or marks:
            continue
        if kind == "id":
            words = {w.lower() for w in PIECES.findall(value)} - FILLERS
            marks = tag in PARTS and bool(words) and words <= (FOREIGN if in_article else FURNITURE)
        else:
            marks = any(map(marks_furniture, value.split()))
    return ".".join([tag, *sorted(set(filter(None, classes)))]), marks


class Page:
    """Blocks of a page: (text, link characters, paths of the containers around, innermost first)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, list[int]]] = []
        self.paths: list[str] = []  # by container number
        self._read(source)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.blocks.append((text, self.links, list(self.around)))
        self.parts, self.links = [], 0

    def _pop(self) -> None:
        tag, _, furniture, container = self.stack.pop()
        if tag in BLOCKS or furniture:
            self._flush()
        self.hidden -= furniture
        self.linked -= tag == "a"
        if container:
            self.around.pop(0)

    def _read(self, source: str) -> None:
        self.parts: list[str] = []
        self.links = self.hidden = self.linked = 0
        self.around: list[int] = []
        self.stack: list[tuple[str, str, bool, bool]] = []
        at = 0
        for m in MARKUP.finditer(source):
            if m.start() > at and not self.hidden:
                self._text(source[at : m.start()])
            at = m.end()
            if m[1] or m[3] is None and m[6] is None:
                continue
            closing, tag, attributes = (m[2], m[3], m[4]) if m[3] is not None else (m[5], m[6], m[7])
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag == "br":
                self.parts.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            else:
                self._open(tag, attributes)
        if at < len(source) and not self.hidden:
            self._text(source[at:])
        while self.stack:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        self.parts.append(text)
        if self.linked:
            self.links += len(text)

    def _open(self, tag: str, attributes: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1) if tag in CLOSES else ():
            if self.stack[i][0] in CLOSES[tag]:
                while len(self.stack) > i:
                    self._pop()
                break
            if self.stack[i][0] in FENCES:
                break
        step, furniture = step_of(tag, attributes, any(e[0] == "article" for e in self.stack))
        if tag in BLOCKS or furniture:
            self._flush()
        path = f"{self.stack[-1][1]}/{step}" if self.stack and step and tag in CONTAINERS else self.stack[-1][1] if self.stack else step
        container = tag in CONTAINERS and not self.hidden and not furniture
        self.stack.append((tag, path, furniture, container))
        self.hidden += furniture
        self.linked += tag == "a"
        if container:
            self.around.insert(0, len(self.paths))
            self.paths.append(path)

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in FENCES and tag not in BLOCKS and tag not in SKIPPED:
                return

    def scores(self) -> dict[int, float]:
        """Of each container: the text outside links of its blocks, halved at each container on the way that holds more than the one inside it."""
        held: dict[int, int] = {}
        for text, _, around in self.blocks:
            for c in around:
                held[c] = held.get(c, 0) + len(text)
        out: dict[int, float] = {}
        for text, links, around in self.blocks:
            value, inner = float(max(0, len(text) - 2 * links)), None
            for c in around:
                if inner is not None and held[c] > held[inner]:
                    value /= 2
                out[c] = out.get(c, 0.0) + value
                inner = c
        return out

    def votes(self) -> dict[str, float]:
        """Paths of containers with at least half the best score, as shares of the best."""
        scores = self.scores()
        best = max(scores.values(), default=0.0)
        out: dict[str, float] = {}
        for c, s in scores.items():
            if best and s >= best / 2:
                out[self.paths[c]] = max(out.get(self.paths[c], 0.0), s / best)
        return out

    def text(self, path: str | None) -> str:
        """Blocks in the elements at the path; without any, in the best container of the page."""
        chosen = {c for c, p in enumerate(self.paths) if p == path}
        found = [text for text, _, around in self.blocks if not chosen.isdisjoint(around)]
        if not found:
            scores = self.scores()
            if not scores:
                return "\n".join(text for text, _, around in self.blocks)
            best = max(scores, key=lambda c: (scores[c], -c))
            found = [text for text, _, around in self.blocks if best in around]
        return "\n".join(found)


#: Hosts up to this number are broadcast with their winning paths (a short string each); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: A host's pages spread over so many parts in that join.
SALT = 64


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("__host", F.coalesce(host, F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """__host, __path: the path with most votes per host; ties go to the longer, then the first path."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], float] = {}
        for batch in batches:
            for host, source in zip(batch.column("__host"), batch.column("html"), strict=True):
                for path, share in Page(source.as_py() or "").votes().items():
                    key = (host.as_py(), path)
                    sums[key] = sums.get(key, 0.0) + share
            if len(sums) > 50_000:
                yield pack(sums)
                sums = {}
        yield pack(sums)

    def pack(sums: dict) -> pa.RecordBatch:
        # whole numbers, so that the order of additions can't matter
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([round(v * 1000) for v in sums.values()], pa.int64())], names=["__host", "__path", "votes"])

    votes = with_host(pages).where("__host <> ''").select("__host", "html").mapInArrow(run, "__host string, __path string, votes long")
    summed = votes.groupBy("__host", "__path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("__host").agg(F.max(F.struct("votes", F.length("__path").alias("n"), "__path")).alias("best")).select("__host", F.col("best.__path").alias("__path"))


def extract(pages: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns of every page and its main text."""
    winners = stage(winning_paths(pages), "host-paths")
    named = with_host(pages.select(*dict.fromkeys([*columns, "url", "html"])))
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = named.join(F.broadcast(winners), "__host", "left")
    else:
        salted = winners.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = named.withColumn("__salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALT)).cast("int")).join(salted, ["__host", "__salt"], "left")
    types = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py() or "").text(path.as_py()) for source, path in zip(batch.column("__html"), batch.column("__path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(texts, pa.string())], names=[*columns, "text"])

    return joined.select(*columns, F.col("html").alias("__html"), "__path").mapInArrow(run, types)


def op8_consensus_html(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ship(__name__)


# pages whose article is one element without furniture inside, as in the given tables
OP8_SQL = r"""
with a as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '<br\s*/?>', ' ', 'g') as x from pages
), b as (
  select page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h[1-6]|ul|ol|li|div|blockquote|pre|article)(?:\s[^>]*)?>'), lambda t:
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'),
      '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&middot;', '·'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'))) as blocks from a
), c as (select page_id, url, array_to_string(list_filter(blocks, lambda t: t <> ''), chr(10)) as text from b)
select page_id, url, text, cast(length(text) as bigint) as n_chars from c
"""
