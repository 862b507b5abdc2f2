"""Main text of web pages by wrappers (operator 12).

Every page is turned into a stream of block tags and text slots, folded into a union-free expression (:mod:`pages`). The distinct
expressions of a host are merged in groups of bounded size, round after round, into one wrapper that fits all its pages: where they
differ, parts become optional or repeated. A page is then laid against its host's wrapper, and the slots that count are read.

Which slots count: those inside an ``article`` that is not itself a comment or an advert (without one, inside ``main``), less what tags,
roles and classes name as menus, adverts and the like. On pages that mark no main part, the slots of the wrapper decide by what they
hold on all pages of the host: slots of one and the same text and slots of links fall out, and the smallest element with most of
the rest is the main part.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.llm import pages
from threadloom.llm.common import small_side
from threadloom.llm.grams import give_back
from threadloom.llm.urls import host_and_path
from threadloom.session import cut_lineage

#: Expressions merged by one task call, on average.
MERGED_AT_ONCE = 64
#: Wrappers up to this many rows and bytes go to every task; with more, pages meet them by a shuffle.
BROADCAST_WRAPPERS, BROADCAST_BYTES = 20_000, 32 << 20
#: A slot says the same on every page of at least so many: it belongs to the template.
LEAST_PAGES = 3
#: A slot with more than this share of its characters in links is a menu; a main part has at least that share of what counts.
LINKS, MOST = 0.5, 0.7
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _regions(node: pages.Node, suffix: str) -> bool:
    """Whether there is an element of this kind with nothing against it around it."""
    return any(isinstance(k, pages.Node) and not k.key.endswith("!") and (k.key == suffix or _regions(k, suffix)) for k in node.kids)


def main_key(root: pages.Node) -> str | None:
    """What marks the main part of a page: ``article*``, else another element that says it is."""
    if _regions(root, "article*"):
        return "article*"
    return "main*" if _regions(root, "main*") else next((f"{n}*" for n in ("div", "section", "td", "p") if _regions(root, f"{n}*")), None)


def expressions(docs: DataFrame) -> DataFrame:
    """``(host, said, marked)``, distinct: the folded stream of each page, and whether it marks its main part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, marked = [], []
            for page in batch.column(1).to_pylist():
                root = pages.parse(page or "")
                said.append(json.dumps(pages.stream(root), separators=(",", ":")))
                marked.append(main_key(root) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(marked, pa.bool_())], names=["host", "said", "marked"])
        give_back()

    return docs.select("host", "html").mapInArrow(run, "host string, said string, marked boolean").distinct()


def wrappers(found: DataFrame) -> DataFrame:
    """``(host, wrapper, marked)``, one row per host, from :func:`expressions`; ``marked`` holds if all its pages mark their main part.

    Each round deals the expressions of a host by hash into groups of about ``MERGED_AT_ONCE``; a group is merged in order of its
    expressions, so the result is the same for any partitioning.
    """
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        said = functools.reduce(pages.merged, (json.loads(s) for s in sorted(pdf["said"])))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "said": [json.dumps(said, separators=(",", ":"))], "marked": [bool(pdf["marked"].all())]})

    current = cut_lineage(found.groupBy("host", "said").agg(F.min("marked").alias("marked")))
    while True:
        sizes = cut_lineage(current.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        if sizes.isEmpty():
            return current.select("host", F.col("said").alias("wrapper"), "marked")
        side = small_side(sizes.withColumnRenamed("host", "_host"), BROADCAST_WRAPPERS)
        dealt = current.join(side, F.col("host").eqNullSafe(F.col("_host")), "left").withColumn(
            "part", F.pmod(F.xxhash64("said"), F.ceil(F.coalesce("n", F.lit(1)) / MERGED_AT_ONCE)).cast("long"))
        alone = dealt.filter("n is null").select("host", "said", "marked")
        together = dealt.filter("n is not null").groupBy("host", "part").applyInPandas(merge, "host string, said string, marked boolean")
        current = cut_lineage(alone.unionByName(together))


class Wrapper:
    """An expression laid out, with numbered places."""

    def __init__(self, said: str):
        self.places = pages.laid_out(json.loads(said), itertools.count())


@functools.lru_cache(4096)
def wrapper(said: str) -> Wrapper:
    return Wrapper(said)


def slots(node: pages.Node, places: list[pages.Place]) -> Iterator[tuple[int, list]]:
    """``(number, pieces)`` of every slot outside of elements that hold nothing of an article."""
    for key, part, place in pages.matched(node, places):
        if key == "#":
            yield (-1 if place is None else place.number), part
        elif not key.endswith("!"):
            yield from slots(part, [] if place is None else place.inner)


def slot_sums(docs: DataFrame) -> DataFrame:
    """``(host, wrapper, slot, said_on, chars, linked, same)`` over pages that mark no main part; input ``(host, html, wrapper)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, said in zip(*(batch.column(i).to_pylist() for i in range(3))):
                root = pages.parse(page or "")
                if main_key(root) is None:
                    texts: dict[int, list] = {}
                    for number, pieces in slots(root, wrapper(said).places):
                        texts.setdefault(number, []).append((" ".join(pages.spelled(pieces).split()), pages.linked(pieces)))
                    rows += [(host, said, number, sum(len(t) for t, _ in of), sum(n for _, n in of), xxhash.xxh64_intdigest("\n".join(t for t, _ in of)) >> 1)
                             for number, of in texts.items()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["host", "wrapper", "slot", "chars", "linked", "mark"])
        give_back()

    told = docs.select("host", "html", "wrapper").mapInArrow(run, "host string, wrapper string, slot int, chars long, linked long, mark long")
    return told.groupBy("host", "wrapper", "slot").agg(F.count(F.lit(1)).alias("said_on"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
                                                       (F.min("mark") == F.max("mark")).alias("same"))


def _chosen(said: str, sums: dict[int, tuple[int, int, int, bool]]) -> list[int]:
    """The slots of the main part of a wrapper, from the sums of its slots."""
    counts = {n: chars for n, (on, chars, links, same) in sums.items() if not (same and on >= LEAST_PAGES) and links <= LINKS * chars}

    def inside(places: list[pages.Place]) -> set[int]:
        return {n for p in places for n in ([p.number] if p.key == "#" else inside(p.inner))}

    here, places = set(counts), wrapper(said).places
    total = sum(counts.values())
    while True:
        best = max((p for p in places if p.inner), key=lambda p: sum(counts.get(n, 0) for n in inside(p.inner)), default=None)
        if best is None or sum(counts.get(n, 0) for n in inside(best.inner)) < MOST * total:
            return sorted(here)
        here, places = here & inside(best.inner), best.inner


def chosen_slots(sums: DataFrame) -> DataFrame:
    """``(host, slots)``: for each wrapper with sums the numbers of the slots that count. As many rows a host as its wrapper has slots."""
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        told = {int(r.slot): (int(r.said_on), int(r.chars), int(r.linked), bool(r.same)) for r in pdf.itertuples()}
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "slots": [_chosen(pdf["wrapper"].iloc[0], told)]})

    return sums.groupBy("host", "wrapper").applyInPandas(choose, "host string, slots array<int>")


class _Text:
    """Blocks of text in page order."""

    def __init__(self):
        self.blocks, self.open = [], []

    def end(self) -> None:
        block = " ".join("".join(self.open).split())
        if block:
            self.blocks.append(block)
        self.open = []


def main_text(page: str | None, said: str, kept: list[int] | None) -> str:
    """The text of a page laid against its wrapper; ``kept`` are the slots that count on a page without a marked main part."""
    root = pages.parse(page or "")
    key, out, wanted = main_key(root), _Text(), set(kept or ())

    def read(node: pages.Node, places: list[pages.Place], inside: bool, heading: bool) -> None:
        for what, part, place in pages.matched(node, places):
            if what == "#":
                if inside and not heading if key else place is not None and place.number in wanted:
                    out.open.append(pages.spelled(part))
            elif part.inline:  # an inline element that holds nothing of an article
                out.open.append(" ")
            else:
                out.end()
                if not what.endswith("!"):
                    # Of a header inside the main part only headings belong to the article.
                    read(part, [] if place is None else place.inner, inside or what == key, (heading or inside and part.name == "header") and part.name not in _HEADINGS)
                out.end()

    read(root, wrapper(said).places, False, False)
    out.end()
    return "\n".join(out.blocks)


def extract(docs: DataFrame) -> DataFrame:
    """``(page_id, url, host, text, n_chars, wrapper)``, one row per row of ``docs (page_id, url, html)``.

    ``text`` is the main text, blocks joined by a line end, white space inside a block one space, references decoded; empty if there is
    none, for null and for empty pages. A header inside the article gives its headings only. Pages without a host (null URLs, or URLs without ``://``) share one
    wrapper. Pages of any length are read whole; elements nested more than ``pages.DEEPEST`` deep count as part of the one that is not.
    Repeated rows give equal results, one each; the order of rows and partitions doesn't matter; an empty table gives no rows; other
    columns are not used.
    """
    rows = docs.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    found = cut_lineage(wrappers(expressions(rows)))
    bounds = found.agg(F.count(F.lit(1)), F.sum(F.length("wrapper"))).first()  # two numbers

    def with_wrappers(some: DataFrame) -> DataFrame:
        side = F.broadcast(some) if bounds[0] <= BROADCAST_WRAPPERS and (bounds[1] or 0) <= BROADCAST_BYTES else some
        return rows.join(side.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).drop("_host")

    plain = found.filter(~F.col("marked")).select("host", "wrapper")
    if plain.isEmpty():
        told = found.select("host", "wrapper", F.lit(None).cast("array<int>").alias("slots"))
    else:
        slots_of = chosen_slots(slot_sums(with_wrappers(plain).select("host", "html", "wrapper")))
        told = cut_lineage(found.join(slots_of, "host", "left").select("host", "wrapper", "slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = [main_text(*row) for row in zip(*(column[c].to_pylist() for c in ("html", "wrapper", "slots")))]
            yield pa.RecordBatch.from_arrays([column["page_id"], column["url"], column["host"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), column["wrapper"]],
                                             names=["page_id", "url", "host", "text", "n_chars", "wrapper"])
        give_back()

    kind = docs.schema["page_id"].dataType.simpleString()
    return with_wrappers(told).select("page_id", "url", "host", "html", "wrapper", "slots").mapInArrow(
        run, f"page_id {kind}, url string, host string, text string, n_chars long, wrapper string")
