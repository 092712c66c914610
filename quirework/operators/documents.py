"""Outlines, bookmarks, recent items, tabs, forms and print settings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp_setting
from ..plans.keys import key_back, key_text
from ..plans.scan import ordered_scan, range_chunks
from ..plans.settle import settle

# Paper sizes and margins in inches, and the settings of a document without any.
PAPER = {"letter": (8.5, 11.0), "a4": (8.27, 11.69), "legal": (8.5, 14.0), "tabloid": (11.0, 17.0), "custom": (8.5, 11.0)}
MARGINS = {"none": 0.0, "narrow": 0.25, "normal": 0.5, "wide": 1.0, "custom": 0.5}
DEFAULTS = {
    "orientation": "auto", "page_size": "letter", "pages_per_sheet": 1, "page_order": "horizontal", "margin_preset": "none",
    "scaling_mode": "fit", "custom_scale": 100.0, "print_range": "all", "custom_range": "",
}


# -- outline -------------------------------------------------------------------------------------------------


def _list_ranks(steps: DataFrame) -> DataFrame:
    """(doc, item, rank): number of counted items before each item of a document's list.

    ``steps`` has doc, item, following (null at the end) and counts (0 or 1).  Links are doubled: in each round an item adds
    what its link's end has added up, so a list of n items takes log n rounds.
    """
    now = settle(steps.select("doc", "item", "following", F.col("counts").cast("long").alias("sum")))
    while not now.filter(F.col("following").isNotNull()).isEmpty():
        ahead = now.select("doc", F.col("item").alias("following"), F.col("following").alias("_f"), F.col("sum").alias("_s"))
        now = settle(now.join(ahead, ["doc", "following"], "left").select(
            "doc", "item", F.col("_f").alias("following"), (F.col("sum") + F.coalesce("_s", F.lit(0))).alias("sum")))
    total = now.groupBy("doc").agg(F.max("sum").alias("_all"))
    return now.join(total, "doc").select("doc", "item", (F.col("_all") - F.col("sum")).alias("rank"))


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """Outline in depth-first order with path titles ``Parent > Child``.

    ``nodes`` is an adjacency table.  Links to parents are doubled, which brings titles from the roots down in a number of rounds
    that is the logarithm of the depth; nodes on a cycle, or below one or an unknown parent, never arrive and drop out.  Positions
    are ranks in the tour that enters and leaves every node, found by doubling too, so no key grows with the depth.  Siblings
    follow ``ord``, then ``node_id``.  Unknown pages become 0, blank titles Untitled.
    """
    n = nodes.select(key_text("doc_id").alias("doc"), "node_id", "parent_id", "ord", F.coalesce("title", F.lit("")).alias("title"), "page_number")
    n = settle(n)
    links = settle(n.select("doc", "node_id", F.col("parent_id").alias("up")))
    most = n.groupBy("doc").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(most - 1, 0).bit_length()):
        above = links.select("doc", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.lit(True).alias("_there"))
        # An unknown parent is an end that is no root.
        links = settle(links.join(above, ["doc", "up"], "left").filter(F.col("up").isNull() | F.col("_there")).select(
            "doc", "node_id", F.col("_up").alias("up")))
        if links.filter(F.col("up").isNotNull()).isEmpty():
            break
    rooted = settle(links.filter(F.col("up").isNull()).select("doc", "node_id"))
    # Up: the next node to ask; the titles from below it down to the node in a row, where the first one that isn't empty
    # begins, whether there is none, and the number of steps.
    blank, text = F.col("title") == "", F.col("path")
    now = settle(n.join(rooted, ["doc", "node_id"], "left_semi").select(
        "doc", "node_id", F.col("parent_id").alias("up"), F.col("title").alias("path"), F.lit(0).alias("skip"),
        blank.alias("blank"), F.lit(1).alias("steps")))
    while not now.filter(F.col("up").isNotNull()).isEmpty():
        above = now.select("doc", F.col("node_id").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "path", "skip", "blank", "steps")])
        root = F.col("_path").isNull()
        now = settle(now.join(above, ["doc", "up"], "left").select(
            "doc", "node_id", F.col("_up").alias("up"),
            F.when(root, text).otherwise(F.concat("_path", F.lit(" > "), "path")).alias("path"),
            F.when(root, F.col("skip")).when(F.col("_blank"), F.length("_path") + 3 + F.col("skip")).otherwise(F.col("_skip")).alias("skip"),
            (F.col("blank") & F.coalesce("_blank", F.lit(True))).alias("blank"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))

    tree = settle(n.join(rooted, ["doc", "node_id"], "left_semi"))
    family, at = ["doc", "parent_id"], [F.col("ord"), F.col("node_id")]
    tree = settle(ordered_scan(range_chunks(tree, family, at, "_range"), family, F.col("_range"), at, rank="nth", leads={"next": F.col("node_id")}))
    child = tree.filter("nth = 0 and parent_id is not null").select("doc", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    enter, leave = (lambda x, s=s: F.when(x.isNotNull(), F.struct(x.alias("n"), F.lit(s).alias("out"))) for s in (False, True))
    me = F.col("node_id")
    tour = tree.join(child, ["doc", "node_id"], "left").select("doc", F.explode(F.array(
        F.struct(enter(me).alias("item"), F.coalesce(enter(F.col("child")), leave(me)).alias("following"), F.lit(1).alias("counts")),
        F.struct(leave(me).alias("item"), F.coalesce(enter(F.col("next")), leave(F.col("parent_id"))).alias("following"), F.lit(0).alias("counts")),
    )).alias("s")).select("doc", "s.*")
    place = _list_ranks(tour).filter(~F.col("item.out")).select("doc", F.col("item.n").alias("node_id"), F.col("rank").alias("position"))
    path = F.when(F.col("blank"), "").otherwise(F.substring(text, F.col("skip") + 1, F.length(text)))
    out = now.select("doc", "node_id", path.alias("title"), (F.col("steps") - 1).alias("depth")).join(place, ["doc", "node_id"]).join(
        n.select("doc", "node_id", "page_number"), ["doc", "node_id"])
    return out.select(
        key_back("doc", nodes.schema["doc_id"].dataType).alias("doc_id"), "node_id",
        F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"),
        F.coalesce("page_number", F.lit(0)).alias("page_number"), "depth", "position")


def merge_bookmarks(native: DataFrame, app: DataFrame) -> DataFrame:
    """Bookmarks of the file, then of the application; the first per page and title stays."""
    both = native.withColumn("_src", F.lit(0)).unionByName(app.withColumn("_src", F.lit(1)))
    rest = [c for c in native.columns if c not in ("doc_id", "page_number", "title")]
    first = both.groupBy("doc_id", "page_number", "title").agg(
        F.min_by(F.struct(*rest), F.struct("_src", "bookmark_id")).alias("_b"))
    return first.select("doc_id", "page_number", "title", "_b.*")


# -- recents -------------------------------------------------------------------------------------------------


def recent_files(events: DataFrame, k, by=None) -> DataFrame:
    """Latest opening per path, newest first, ``k`` in all or per value of ``by``."""
    keys = [by] if by else []
    last = events.groupBy(*keys, "path").agg(F.max("ts").alias("last_opened"), F.max_by("name", "ts").alias("name"))
    if not by:
        return last.orderBy(F.desc("last_opened"), "path").limit(k)
    # A rank limit also runs before the shuffle, so a busy user sends at most k rows per task.
    w = Window.partitionBy(by).orderBy(F.desc("last_opened"), "path")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recent_stamps(uses: DataFrame, stamps: DataFrame, keep, show) -> DataFrame:
    """Stamps used last per user: ``keep`` are remembered, the first ``show`` that still exist are returned."""
    last = uses.groupBy("user_id", "stamp_id").agg(F.max("ts").alias("last_used"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last_used"), "stamp_id")
    kept = last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    known = kept.join(stamps, "stamp_id")
    shown = Window.partitionBy("user_id").orderBy("rank")
    return known.withColumn("_n", F.row_number().over(shown)).filter(F.col("_n") <= show).drop("_n")


def active_after_close(tabs: DataFrame, closed: DataFrame) -> DataFrame:
    """Tab that becomes active when ``closed`` ones go: the nearest before it that stays open, else the nearest after."""
    gone = closed.select("user_id", "tab_id").distinct().withColumn("_gone", F.lit(True))
    marked = tabs.join(gone, ["user_id", "tab_id"], "left")

    def nearest(df, place, name):
        """Tab id of the last open row before each one, along ``place``."""
        open_ = F.when(F.col("_gone").isNull(), F.struct((-place).alias("p"), F.col("tab_id").alias("t")))
        return ordered_scan(df, ["user_id"], F.floor(place / 1024), [place], mins={name: open_})

    both = nearest(nearest(marked, F.col("ord"), "_before"), -F.col("ord"), "_after")
    return both.filter("_gone").select(
        "user_id", F.col("tab_id").alias("closed_id"), F.coalesce("_before.t", "_after.t").alias("active_id"))


def document_status(events: DataFrame) -> DataFrame:
    """Last save and modified flag from ``edit`` and ``save`` events (``doc_id, ts, kind``)."""
    when = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts")))
    folded = events.groupBy("doc_id").agg(when("edit").alias("last_edit"), when("save").alias("last_saved"))
    modified = F.col("last_edit").isNotNull() & (F.col("last_saved").isNull() | (F.col("last_edit") > F.col("last_saved")))
    return folded.select("doc_id", "last_saved", modified.alias("is_modified"))


def active_documents(opens: DataFrame) -> DataFrame:
    """Active document per user: opening one that is open only activates it again."""
    return opens.groupBy("user_id").agg(
        F.max_by("path", F.struct("ts", "event_id")).alias("active_path"), F.count_distinct("path").alias("open_tabs"))


# -- forms ---------------------------------------------------------------------------------------------------


def fill_forms(fields: DataFrame, given: DataFrame) -> DataFrame:
    """Set field values by document and name: text and date also as default, toggles as Yes / Off.

    Of several values for one field the one with the highest ``ord`` counts (a column of ``given``; without it, the
    largest value)."""
    order = F.struct(*([F.col("ord")] if "ord" in given.columns else []), "value_str", "value_bool")
    given = given.groupBy("doc_id", "field_name").agg(F.max(order).alias("_last")).select("doc_id", "field_name", "_last.*")
    v = given.select(
        "doc_id", "field_name", F.col("value_str").alias("_s"), F.col("value_bool").alias("_b"), F.lit(True).alias("_set"))
    j = fields.join(v, ["doc_id", "field_name"], "left")
    kind, given_ = F.col("field_type"), F.coalesce("_set", F.lit(False))
    toggles, text = kind.isin("checkbox", "radio"), kind.isin("text", "date")
    on = F.coalesce("_b", F.lit(False))
    written = F.when(text, F.coalesce("_s", F.lit(""))).when(kind == "dropdown", F.col("_s"))
    fresh = {
        "value_str": F.when(given_ & ~toggles, F.coalesce(written, F.col("value_str"))).otherwise(F.col("value_str")),
        "value_bool": F.when(given_ & toggles, on).otherwise(F.col("value_bool")),
    }
    return j.select(
        *[fresh.get(c, F.col(c)).alias(c) for c in fields.columns],
        F.when(given_ & text, written).alias("default_value"),
        F.when(given_ & toggles, F.when(on, "Yes").otherwise("Off")).alias("state"))


# -- print settings ------------------------------------------------------------------------------------------


def _lookup(table, key):
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


_SIZE, _MARGINS = ("custom_width", "custom_height"), ("margin_top", "margin_right", "margin_bottom", "margin_left")


def _by_preset(value):
    """Custom size and margins that a preset stands for, by the names of their columns."""
    out = {c: _lookup({k: v[i] for k, v in PAPER.items()}, value("page_size")) for i, c in enumerate(_SIZE)}
    return out | {c: _lookup(MARGINS, value("margin_preset")) for c in _MARGINS}


def effective_settings(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of every document: stored values over defaults; a preset overwrites the custom size and margins.

    Ids are compared as text, as the stored ones are text.  Columns of ``settings`` may be missing.
    """
    own = settings.select(F.col("doc_id").cast("string").alias("_doc"), *[F.col(c).alias(f"_s_{c}") for c in settings.columns if c != "doc_id"])
    j = docs.select("doc_id", F.col("doc_id").cast("string").alias("_doc")).join(own, "_doc", "left")
    value = {n: F.coalesce(f"_s_{n}", F.lit(d)) if f"_s_{n}" in own.columns else F.lit(d) for n, d in DEFAULTS.items()}
    value["custom_scale"] = clamp_setting(value["custom_scale"], "print_scale")
    preset = _by_preset(value.get)

    def custom(name, by):
        given = F.coalesce(f"_s_{name}", preset[name]) if f"_s_{name}" in own.columns else preset[name]
        return F.when(value[by] == "custom", given).otherwise(preset[name]).alias(name)

    return j.select("doc_id", *[v.alias(n) for n, v in value.items()],
                    *[custom(c, "page_size") for c in _SIZE], *[custom(c, "margin_preset") for c in _MARGINS])


def edit_settings(settings: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored settings after a log of edits: ``doc_id, ts, event_id, action`` and any of the setting columns.

    ``set`` takes over the values that are given; a size or margin preset takes its custom values along, a custom size or margin
    makes the preset ``custom``.  ``reset`` puts all defaults, ``remove`` drops the document.  An edit of a document that isn't
    there begins with the defaults.  One aggregation with partial results per document.
    """
    fields = [*DEFAULTS, *_SIZE, *_MARGINS]
    at = F.struct("ts", "event_id")
    given = {f: F.col(f) if f in edits.columns else F.lit(None) for f in fields}
    preset = _by_preset(given.get)
    sized, framed = (F.coalesce(*[given[c].cast("double") for c in cs]).isNotNull() for cs in (_SIZE, _MARGINS))
    new = {f: F.coalesce(given[f], preset[f]) if f in preset else given[f] for f in fields}
    new["page_size"] = F.when(sized, F.lit("custom")).otherwise(given["page_size"])
    new["margin_preset"] = F.when(framed, F.lit("custom")).otherwise(given["margin_preset"])
    whole = F.col("action").isin("reset", "remove")
    aggs = [F.max(F.when(whole, F.struct(at.alias("at"), F.col("action").alias("action")))).alias("_whole"),
            F.max(F.when(F.col("action") == "set", at)).alias("_set")]
    aggs += [F.max(F.when((F.col("action") == "set") & new[f].isNotNull(), F.struct(at.alias("at"), new[f].alias("v")))).alias(f"_n_{f}") for f in fields]
    net = edits.withColumn("_doc", F.col("doc_id").cast("string")).groupBy("_doc").agg(*aggs)
    old = settings.select(F.col("doc_id").cast("string").alias("_doc"), F.lit(True).alias("_old"),
                          *[(F.col(f) if f in settings.columns else F.lit(None)).alias(f"_o_{f}") for f in fields])
    j = old.join(net, "_doc", "full_outer")
    base = {**{f: F.lit(v) for f, v in DEFAULTS.items()}, **{c: F.lit(PAPER[DEFAULTS["page_size"]][i]) for i, c in enumerate(_SIZE)},
            **{c: F.lit(MARGINS[DEFAULTS["margin_preset"]]) for c in _MARGINS}}
    fresh = F.col("_whole").isNotNull() | F.col("_old").isNull()
    later = lambda x: F.col("_whole").isNull() | (x > F.col("_whole.at"))

    def final(f):
        start = F.when(fresh, base[f]).otherwise(F.col(f"_o_{f}"))
        return F.when(F.col(f"_n_{f}").isNotNull() & later(F.col(f"_n_{f}.at")), F.col(f"_n_{f}.v")).otherwise(start).alias(f)

    dropped = F.coalesce(F.col("_whole.action") == "remove", F.lit(False)) & ~F.coalesce(later(F.col("_set")), F.lit(False))
    something = F.col("_old").isNotNull() | F.col("_whole").isNotNull() | F.col("_set").isNotNull()
    return j.filter(~dropped & something).select(F.col("_doc").alias("doc_id"), *[final(f) for f in fields])
