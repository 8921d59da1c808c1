"""Operator 3. Chat formatting: quotation linking.

Each line's nested quote level (`>` marks) is parsed; a run of lines of one level is a passage. A passage is normalised with its lines joined, so
that a quote which a mail client wrapped anew is still the same text, and is looked up by units: its sentences, its single lines, and its runs
of SHINGLE words (they find quotes that start or end within a sentence). The query looks up every run. The SQL, and `threads` without every_run, look
up a fixed quarter, chosen by digest; these come first in both, so a passage that links by the SQL links to the same message in the query.
Units of unquoted text index the messages that wrote them (per unit only the earliest message of a conversation, and of all, so a phrase that
a third of all messages share is one row); units of quoted passages are joined to that index, in their own conversation first. A passage links where
its first linked unit does, sentences before lines before word runs (that quarter, then the rest). The message of the shallowest and latest-standing passage that links is
the parent. Root and depth come from pointer jumping; the place in reply order (parent before its replies, replies by turn) from list ranking
along the tour of each thread, by pointer jumping too, so neither needs a whole thread in one task.

Quotes go, and so does an attribution line ("On ... wrote:") if the next line that isn't blank is quoted; all other text stays.

Null texts are empty messages. Messages that quote nothing known are roots. A repeated row is one message as often as it stands (all
with the same links and place); rows of one conv_id and turn with unlike texts are one message in the links. Null conv_id or turn: the message is kept,
unlinked. An empty table gives no rows. Messages link only to earlier ones, so there are no cycles. Units agree if 128 bits of digest do. Single words link
within a conversation only. Texts of any length are parsed whole. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialise, table

#: Words in a run; least words of a unit that links to other conversations.
SHINGLE, FAR_WORDS = 5, 4
#: Quote marks, attribution lines (with what stands between them and the quote), ends of sentences.
QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(^|\n)[ \t]*(?:On [^\n]{0,200}(?:\n[^\n>]{0,100})?[ \n]wrote|[^\n>]{1,80} (?:wrote|said)):[ \t]*((?:\n[ \t]*)*\n[ \t]*>)"
SENTENCE = "\x03|[.!?:;]+[ \t\x04]+"


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, passages: array of "level\\x02body", text): text has no quotes and no attribution lines. In a body \\x04 starts a line and \\x03 is a blank one."""
    whole = F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02\x03\x04", "    "), r"\r\n", "\n")
    for _ in range(2):  # an attribution may follow another
        whole = F.regexp_replace(whole, ATTRIBUTION, "$1$2")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), r"[^>]", ""))
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.split(whole, "\n").alias("lines"))
    # arrays are zipped, not indexed: an expression inside a lambda would be evaluated for each element anew
    levels, bare = F.transform("lines", level), F.transform("lines", lambda x: F.regexp_replace(x, QUOTE, ""))
    before = F.concat(F.array(F.lit(-1)), F.slice(levels, 1, F.size("lines") - 1))
    start = F.zip_with(levels, before, lambda x, y: F.when(x == y, "").otherwise(F.concat(F.lit("\x01"), x.cast("string"), F.lit("\x02"))))
    marked = F.zip_with(start, bare, lambda s, x: F.concat(s, F.when(F.trim(x) == "", "\x03").otherwise(F.concat(F.lit("\x04"), x))))
    plain = F.transform(F.filter(F.zip_with(levels, bare, lambda x, y: F.struct(x.alias("level"), y.alias("line"))), lambda x: x["level"] == 0), lambda x: x["line"])
    return m.select("conv_id", "turn", "role", F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda x: x != "").alias("passages"), F.btrim(F.array_join(plain, "\n"), F.lit(" \t\r\n")).alias("text"))


def _units(body: Column, every_run: bool) -> Column:
    """(kind, place, text) of a passage: sentences, lines, runs of words: those that the SQL looks up (kind 2) and, with every_run, the rest (kind 3)."""
    some = lambda a, kind: F.filter(F.transform(a, lambda x, i: F.struct(kind(x).alias("kind"), i.alias("place"), _normal(x).alias("unit"))), lambda u: u["unit"].rlike(r"\p{L}.*\p{L}|\p{N}"))
    words = F.split(_normal(body), " ")
    n = F.greatest(F.size(words) - SHINGLE + 1, F.lit(0))
    runs = F.slice(words, 1, n)
    for i in range(1, SHINGLE):
        runs = F.zip_with(runs, F.slice(words, i + 1, n), lambda x, y: F.concat(x, F.lit(" "), y))
    first = lambda x: F.when(F.substring(F.md5(x.cast("binary")), 1, 1) < "4", 2).otherwise(3)
    units = F.concat(some(F.split(body, SENTENCE), lambda _: F.lit(0)), some(F.split(body, "[\x03\x04]"), lambda _: F.lit(1)), some(runs, first))
    return units if every_run else F.filter(units, lambda u: u["kind"] < 3)


def _passages(parsed: DataFrame, every_run: bool) -> DataFrame:
    """Units of all passages: (conv_id, turn, pos, level, kind, place, k1, k2, n_words)."""
    one = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.posexplode("passages").alias("pos", "p"))
    u = one.select("conv_id", "turn", "pos", F.substring_index("p", "\x02", 1).cast("int").alias("level"), F.explode(_units(F.substring_index("p", "\x02", -1), every_run)).alias("u"))
    return u.select("conv_id", "turn", "pos", "level", "u.kind", "u.place", F.xxhash64("u.unit").alias("k1"), F.xxhash64(F.lit(7), "u.unit").alias("k2"), (F.length("u.unit") - F.length(F.translate("u.unit", " ", "")) + 1).alias("n_words"))


def link(parsed: DataFrame, every_run: bool = False) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, n_quoted, n_linked) of messages that quote; the counts are of passages."""
    units = _passages(parsed, every_run)
    quoted = materialise(units.where("level > 0"), "quoted")
    key = ["k1", "k2"]
    own = units.where("level = 0").join(quoted.select(key).distinct(), key, "left_semi")  # only what is quoted somewhere is indexed
    local = materialise(own.groupBy(*key, "conv_id").agg(F.min("turn").alias("local_turn")), "written")
    every = local.groupBy(key).agg(F.min(F.struct("conv_id", "local_turn")).alias("first"))
    q = quoted.join(local, [*key, "conv_id"], "left").join(every, key, "left")
    here = F.when(F.col("local_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("local_turn").alias("t")))
    far = (F.col("first.conv_id") < F.col("conv_id")) & (F.col("n_words") >= FAR_WORDS)
    there = F.when(far | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.local_turn") < F.col("turn"))), F.struct(F.col("first.conv_id").alias("c"), F.col("first.local_turn").alias("t")))
    q = q.withColumn("to", F.coalesce(here, there))
    p = q.groupBy("conv_id", "turn", "pos").agg(F.min("level").alias("level"), F.min_by("to", F.when(F.col("to").isNotNull(), F.struct("kind", "place", "to"))).alias("to"))
    best = F.min_by("to", F.when(F.col("to").isNotNull(), F.struct(F.col("level"), (-F.col("pos")).alias("b"))))
    return p.groupBy("conv_id", "turn").agg(best.alias("to"), F.count(F.lit(1)).alias("n_quoted"), F.count("to").alias("n_linked")).select("conv_id", "turn", F.col("to.c").alias("parent_conv"), F.col("to.t").alias("parent_turn"), "n_quoted", "n_linked")


def _jumped(at: DataFrame, here: list[str], to: list[str], add: str, tag: str) -> DataFrame:
    """Pointer jumping: rows point from `here` to `to` and carry a sum; a round for each doubling of the way, until every pointer leaves the table. Gives each row's last target and whole sum."""
    at = materialise(at, tag)
    while True:
        up = at.select(*[F.col(h).alias(t) for h, t in zip(here, to, strict=True)], *[F.col(t).alias(f"_{t}") for t in to], F.col(add).alias(f"_{add}"))
        nxt = materialise(at.join(up, to, "left"), tag)
        if nxt.where(f"_{to[0]} IS NOT NULL").isEmpty():
            return at
        at = nxt.select(*here, *[F.coalesce(f"_{t}", t).alias(t) for t in to], (F.col(add) + F.coalesce(f"_{add}", F.lit(0))).alias(add))


def depths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of linked messages."""
    at = links.where("parent_conv IS NOT NULL").select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    return _jumped(at, ["conv_id", "turn"], ["root_conv", "root_turn"], "depth", "links")


def places(links: DataFrame, deep: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_order) of linked messages: how many messages of the thread stand before it in reply order.

    A thread's tour enters a message, tours its replies and leaves it. Each step knows the next one, and the sum of entries up to the tour's end ranks them.
    """
    kids = links.where("parent_conv IS NOT NULL").select("conv_id", "turn", "parent_conv", "parent_turn")
    order = Window.partitionBy("parent_conv", "parent_turn").orderBy("turn", "conv_id")
    kids = materialise(kids.withColumn("next", F.lead(F.struct("conv_id", "turn")).over(order)), "kids")
    first = kids.groupBy(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn")).agg(F.min(F.struct(F.col("turn").alias("t"), F.col("conv_id").alias("c"))).alias("first"))
    step = lambda c, t, s: F.struct(c.alias("c"), t.alias("t"), F.lit(s).alias("s"))
    every = kids.select("conv_id", "turn").unionByName(first.select("conv_id", "turn")).distinct().join(first, ["conv_id", "turn"], "left")
    enter = every.select(step(F.col("conv_id"), F.col("turn"), 0).alias("e"), F.coalesce(F.when(F.col("first").isNotNull(), step(F.col("first.c"), F.col("first.t"), 0)), step(F.col("conv_id"), F.col("turn"), 1)).alias("to"), F.lit(1).cast("long").alias("n"))
    leave = kids.select(step(F.col("conv_id"), F.col("turn"), 1).alias("e"), F.coalesce(F.when(F.col("next").isNotNull(), step(F.col("next.conv_id"), F.col("next.turn"), 0)), step(F.col("parent_conv"), F.col("parent_turn"), 1)).alias("to"), F.lit(0).cast("long").alias("n"))
    ranked = _jumped(enter.unionByName(leave), ["e"], ["to"], "n", "tour").where("e.s = 0").select(F.col("e.c").alias("conv_id"), F.col("e.t").alias("turn"), "n")
    total = ranked.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("n").alias("total"))
    return deep.join(ranked, ["conv_id", "turn"]).join(total, ["root_conv", "root_turn"]).select("conv_id", "turn", (F.col("total") - F.col("n")).alias("reply_order"))


def threads(messages: DataFrame, every_run: bool = False) -> DataFrame:
    """One row a message, without quotes. Ordered by (root_conv, root_turn, reply_order) the rows of one root_conv are a conversation in reply order."""
    parsed = parse(messages)
    links = materialise(link(parsed, every_run), "quotes")
    deep = materialise(depths(links), "depths")
    m = parsed.drop("passages").join(links, ["conv_id", "turn"], "left").join(deep, ["conv_id", "turn"], "left").join(places(links, deep), ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return m.select("conv_id", "turn", "role", "text", "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), zero("depth"), zero("reply_order"), zero("n_quoted"), zero("n_linked"))


def conversations(messages: DataFrame, every_run: bool = False) -> DataFrame:
    """The rows of `threads`, each conversation in one partition and there in reply order; a long one is streamed, not collected."""
    return threads(messages, every_run).repartition("root_conv").sortWithinPartitions("root_conv", "root_turn", "reply_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(table(spark, sf_dir, "conversations"), every_run=True)


_Q = lambda s: "'" + s.replace("'", "''") + "'"
_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
ORACLE = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rn, conv_id, turn, role, regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3) || chr(4), '    '), '\r\n', chr(10), 'g') AS w FROM conversations),
a AS (SELECT rn, conv_id, turn, role, string_split(regexp_replace(regexp_replace(w, {_Q(ATTRIBUTION)}, '\1\2', 'g'), {_Q(ATTRIBUTION)}, '\1\2', 'g'), chr(10)) AS ls FROM m),
l AS (SELECT rn, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM a),
p AS MATERIALIZED (SELECT rn, conv_id, turn, i, length(regexp_replace(regexp_extract(line, {_Q(QUOTE)}, 1), '[^>]', '', 'g')) AS level, regexp_replace(line, {_Q(QUOTE)}, '') AS line FROM l),
r AS (SELECT *, sum(CASE WHEN level = prev THEN 0 ELSE 1 END) OVER (PARTITION BY rn ORDER BY i) AS pos FROM (SELECT *, lag(level) OVER (PARTITION BY rn ORDER BY i) AS prev FROM p)),
b AS (SELECT rn, conv_id, turn, pos, any_value(level) AS level, string_agg(CASE WHEN trim(line, ' ') = '' THEN chr(3) ELSE chr(4) || line END, '' ORDER BY i) AS body FROM r WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
w AS (SELECT *, string_split({_NORMAL.format("body")}, ' ') AS ws FROM b),
u AS (SELECT rn, conv_id, turn, pos, level, 0 AS kind, generate_subscripts(x, 1) AS place, {_NORMAL.format("unnest(x)")} AS unit FROM (SELECT *, regexp_split_to_array(body, chr(3) || '|[.!?:;]+[ ' || chr(9) || chr(4) || ']+') AS x FROM w)
      UNION ALL SELECT rn, conv_id, turn, pos, level, 1, generate_subscripts(x, 1), {_NORMAL.format("unnest(x)")} FROM (SELECT *, regexp_split_to_array(body, '[' || chr(3) || chr(4) || ']') AS x FROM w)
      UNION ALL SELECT rn, conv_id, turn, pos, level, 2, j, unit FROM (SELECT *, array_to_string(ws[j:j + {SHINGLE - 1}], ' ') AS unit FROM (SELECT *, unnest(range(1, len(ws) - {SHINGLE - 2})) AS j FROM w)) WHERE md5(unit)[1] < '4'),
k AS MATERIALIZED (SELECT *, len(string_split(unit, ' ')) AS nw FROM u WHERE regexp_matches(unit, '\p{{L}}.*\p{{L}}|\p{{N}}')),
local AS (SELECT unit, conv_id, min(turn) AS lt FROM k WHERE level = 0 GROUP BY ALL),
first AS (SELECT unit, min(conv_id) AS fc, arg_min(lt, conv_id) AS ft FROM local GROUP BY unit),
q AS (SELECT k.*, CASE WHEN lt < k.turn THEN k.conv_id WHEN (fc < k.conv_id AND nw >= {FAR_WORDS}) OR (fc = k.conv_id AND ft < k.turn) THEN fc END AS tc,
      CASE WHEN lt < k.turn THEN lt WHEN (fc < k.conv_id AND nw >= {FAR_WORDS}) OR (fc = k.conv_id AND ft < k.turn) THEN ft END AS tt
      FROM k LEFT JOIN local ON local.unit = k.unit AND local.conv_id = k.conv_id LEFT JOIN first ON first.unit = k.unit WHERE level > 0),
pas AS (SELECT conv_id, turn, pos, min(level) AS level, min(struct_pack(a := kind, b := place, c := tc, d := tt)) FILTER (WHERE tc IS NOT NULL) AS x FROM q GROUP BY ALL),
par AS MATERIALIZED (SELECT conv_id, turn, count(*) AS nq, count(x) AS nl, min(struct_pack(a := level, b := -pos, c := x.c, d := x.d)) FILTER (WHERE x IS NOT NULL) AS y FROM pas GROUP BY ALL),
up AS (SELECT conv_id, turn, y.c AS rc, y.d AS rt, [turn, conv_id] AS path, 1 AS depth FROM par WHERE y IS NOT NULL
       UNION ALL SELECT up.conv_id, up.turn, par.y.c, par.y.d, [par.turn, par.conv_id] || path, depth + 1 FROM up JOIN par ON par.conv_id = up.rc AND par.turn = up.rt WHERE par.y IS NOT NULL),
root AS (SELECT conv_id, turn, arg_max(rc, depth) AS rc, arg_max(rt, depth) AS rt, arg_max(path, depth) AS path, max(depth) AS depth FROM up GROUP BY ALL),
ord AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY rc, rt ORDER BY path) AS place FROM root),
txt AS (SELECT rn, trim(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ' ' || chr(9) || chr(13) || chr(10)) AS text FROM p GROUP BY rn)
SELECT m.conv_id, m.turn, m.role, coalesce(txt.text, '') AS text, par.y.c AS parent_conv, par.y.d AS parent_turn, coalesce(root.rc, m.conv_id) AS root_conv, coalesce(root.rt, m.turn) AS root_turn,
       coalesce(root.depth, 0)::BIGINT AS depth, coalesce(ord.place, 0)::BIGINT AS reply_order, coalesce(par.nq, 0)::BIGINT AS n_quoted, coalesce(par.nl, 0)::BIGINT AS n_linked
FROM m LEFT JOIN txt USING (rn) LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn LEFT JOIN ord ON ord.conv_id = m.conv_id AND ord.turn = m.turn
"""
