"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one style tree whose nodes are paths of elements with
their classes. Every block of every page enters it, at the node that holds it. Such a node's importance
has a content part, from the entropy of each content over the pages that hold it (the same text on
every page: 0; text of one page only: 1) weighed by length, and a presentation part, from the entropy of
the node's child sequences:

    importance = prior * ((1 - decay ** children) * presentation + decay ** children * mean content importance)

A node is noise if its importance and that of all nodes below it are under ``least``; such branches are
removed from each page of the host. So a wrapper of something important stays, whatever else it holds,
and nodes without text of their own need no importance.

Mark-up is a prior on these importances and removes nothing by itself (but what no browser shows:
scripts, styles, hidden elements); an inline element never takes words out of its line:
- A menu, header, footer, sidebar, form or other branch that its tag, role or a whole class or id names
  has prior 0.2, as have the nodes below it outside an article; one with a listed word in a compound
  name has 0.5.
- Content inside an ``article`` has an importance of 0.8 at least, so that an article repeated on many
  pages is not mistaken for a template.
- On a page whose article holds at least half of the text outside named branches, content outside it counts 0.2.

Each page is parsed once, in time linear in its length at any nesting; blocks, node numbers and child sequences are written, and all that follows
is aggregation and joins. What is important below a node is told upwards twice as far with every join. Aggregates are over (node, content) and (node) with map-side combine: a host
with a third of all pages contributes one row per task and distinct content. Nodes of big hosts are
split off when the list of noise comes back to pages.

Defined results
- Null or empty html: empty text, 0 characters. A null url counts as the empty host.
- A node seen on one page only has the importance of its prior (nothing says that it is a template);
  exact copies of a page on its host count as that one page, so mirrored pages do not erase each other.
- An importance of exactly ``least`` stays.
- Null ``page_id`` and repeated rows: one result each. An empty table: an empty result.
- ``br`` is white space inside its block. Other columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import join_groups, materialize, text_of
from siftlark.llm.markup import ARTICLE, NAMED, NAMED_PRIOR, PLAIN, read_blocks

DECAY, LEAST = 0.9, 0.3
BATCH = 200
#: Share of a content's own importance that counts beside an article, and what an article's content has for certain.
OUTSIDE, ARTICLE_LEAST = 0.2, 0.8
PAGE = (
    "page_id long, url string, host long, page_key long, blocks array<struct<text:string,node:long,weight:double,sure:double>>, "
    "children array<struct<node:long,key:long,width:int,prior:double>>, links array<struct<node:long,parent:long,depth:int>>"
)


#: Up to so many noise nodes go to every executor, by host; more come back to pages by a join.
LISTED_NODES = 20_000


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, page_key (of host and html), blocks and child sequences; nodes are numbered by a hash of host and path."""

    def parse(batches):
        import xxhash

        number = lambda text: xxhash.xxh64_intdigest(text) - (1 << 63)

        def read(host: int, source: str) -> tuple[list, list, list]:
            blocks, nodes = read_blocks(source, host)
            sizes = {m: sum(len(b.text) for b in blocks if b.mark == m) for m in (PLAIN, ARTICLE)}
            beside = sizes[ARTICLE] >= max(sizes[PLAIN], 1)
            weigh = {ARTICLE: (1 - ARTICLE_LEAST, ARTICLE_LEAST), NAMED: (NAMED_PRIOR, 0.0), PLAIN: (OUTSIDE if beside else 1.0, 0.0)}
            found = [{"text": b.text, "node": b.node, "weight": weigh[b.mark][0], "sure": weigh[b.mark][1]} for b in blocks]
            children = [{"node": k, "key": number("\n".join(n.content)), "width": len(n.content), "prior": n.prior} for k, n in nodes.items() if n.holds]
            return found, children, [{"node": k, "parent": n.parent, "depth": n.depth} for k, n in nodes.items() if n.parent is not None]

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                hosts = [number(h) for h in part.column("host").to_pylist()]
                both = [read(h, x) for h, x in zip(hosts, part.column("html").to_pylist())]
                kinds = pa.struct([("text", pa.string()), ("node", pa.int64()), ("weight", pa.float64()), ("sure", pa.float64())])
                child = pa.struct([("node", pa.int64()), ("key", pa.int64()), ("width", pa.int32()), ("prior", pa.float64())])
                link = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32())])
                columns = [part.column("page_id"), part.column("url"), pa.array(hosts, pa.int64()), part.column("page_key"), *(pa.array(list(x), pa.list_(k)) for x, k in zip(zip(*both), (kinds, child, link)))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page_key", "blocks", "children", "links"])

    url = F.col("url").cast("string")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), text_of("html").alias("html"))
    return source.withColumn("page_key", F.xxhash64("host", "html")).mapInArrow(parse, PAGE)


def style_tree(read: DataFrame, decay: float = DECAY) -> DataFrame:
    """host, node, n_pages and importance of the nodes that hold text."""
    # A content that one page repeats counts once on that page, and a page and its exact copies count once.
    shown = read.select("host", "page_key", F.explode("children").alias("c")).select("host", "page_key", "c.*").dropDuplicates(["page_key", "node"])
    sequences = shown.groupBy("host", "node", "key", "prior").agg(F.count("*").alias("n"), F.sum("width").alias("width"))
    children = sequences.groupBy("host", "node", "prior").agg(
        F.sum("n").alias("n_pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), (F.sum("width") / F.sum("n")).alias("width"),
    )
    texts = read.select("page_key", F.explode("blocks").alias("b")).where("b.node IS NOT NULL").select(
        "page_key", F.col("b.node").alias("node"), F.xxhash64("b.text").alias("key"), F.length("b.text").alias("size"), F.col("b.weight").alias("weight"), F.col("b.sure").alias("sure")
    )
    met = texts.distinct().groupBy("node", "key", "size", "weight", "sure").agg(F.count("*").alias("n"))
    chars = F.col("n") * F.col("size")
    contents = met.groupBy("node").agg(
        F.sum(chars).alias("chars"),
        F.sum(chars * (F.col("weight") + F.col("sure"))).alias("most"),
        F.sum(chars * F.col("weight") * F.log("n")).alias("shared"),
    )
    pages = F.log("n_pages")
    presentation = F.when(F.col("n_pages") > 1, (pages - F.col("n_log_n") / F.col("n_pages")) / pages).otherwise(F.lit(1.0))
    content = (F.col("most") - F.when(F.col("n_pages") > 1, F.col("shared") / pages).otherwise(F.lit(0.0))) / F.col("chars")
    alone = F.pow(F.lit(decay), F.col("width"))
    own = (1 - alone) * presentation + alone * content
    importance = F.when(F.col("prior") < 0, F.lit(ARTICLE_LEAST) + F.lit(1 - ARTICLE_LEAST) * own).otherwise(F.col("prior") * own)
    return children.join(contents, "node").select("host", "node", "n_pages", importance.alias("importance"))


def nodes_above(links: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes above those of ``below`` (node), themselves included, by links (node, parent, depth) followed twice as far with every step."""
    deepest = links.agg(F.max("depth")).first()[0] or 1
    found, jumps, reach = below.select("node").distinct(), links.select("node", F.col("parent").alias("up")), 1
    while reach < deepest:
        found = materialize(found.unionByName(found.join(jumps, "node").select(F.col("up").alias("node"))).distinct(), "nodes_above")
        onward = jumps.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        reach *= 2
        if reach < deepest:
            jumps = materialize(jumps.join(onward, "up").select("node", F.col("upper").alias("up")), "node_jumps")
    return found


def noise_nodes(tree: DataFrame, links: DataFrame, least: float = LEAST) -> DataFrame:
    """host, node and n_pages of the nodes that are of low importance with all that is below them."""
    held = nodes_above(links, tree.where(F.col("importance") >= least))
    return tree.where(F.col("importance") < least).select("host", "node", "n_pages").join(held, "node", "left_anti")


def extract_main_text(pages: DataFrame, least: float = LEAST, decay: float = DECAY) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    read = materialize(read_pages(pages), "parsed_pages", "zstd")
    tree = materialize(style_tree(read, decay), "style_tree")
    links = materialize(read.select(F.explode("links").alias("k")).select("k.*").distinct(), "style_links")
    noise = materialize(noise_nodes(tree, links, least), "noise_nodes")
    if noise.count() <= LISTED_NODES:
        by_host = noise.groupBy("host").agg(F.collect_set("node").alias("noise"))
        joined = read.join(F.broadcast(by_host), "host", "left")
    else:
        nodes = read.select("page_key", F.explode(F.transform("blocks", lambda b: b["node"])).alias("node")).where("node IS NOT NULL").distinct()
        by_page = join_groups(nodes, noise.select("node", "n_pages"), "node", "n_pages").groupBy("page_key").agg(F.collect_set("node").alias("noise"))
        joined = read.join(by_page, "page_key", "left")
    listed = F.coalesce("noise", F.array().cast("array<long>"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~F.coalesce(F.array_contains(listed, b["node"]), F.lit(False))), lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
