"""Secrets in texts: fixed patterns, and strings of high entropy. DataFrame operations only.

Base kinds are `assign`, `access` and `hex`. The method adds `entropy`: candidate strings of a character class are scanned by a
window of WINDOW characters, whose Shannon entropy is kept up by adding the character that enters and taking off the one that
leaves: counts of 5 bits each lie packed in a few longs, so that a step is the same few operations whatever the window and the alphabet.
Windows at or above the class's threshold join to spans, as do spans of two classes that overlap. Candidates on the allow-list (of too
few kinds of characters, UUIDs, documented example keys) are passed over, as are spans that meet a base span.

Entropy is exact here: a window's sum of c*log2(c) is kept in integers, from a table in millionths of a bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of fewer characters can't hold one of more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Bits by the fixture of keys and other strings in tests/llm/test_secrets.py. class: candidate pattern, alphabet, bits, patterns that a candidate must all hold
CLASSES = {
    "hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 3.0, (r"[0-9]", r"[A-Fa-f]")),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.95, (r"[0-9]", r"[a-z]", r"[A-Z]")),
}
ALLOWED = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|EXAMPLE|^[0-9_=/+-]+$"

PACKED = 12  # counts in a long
TABLE = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1))]


def limit(bits: float) -> int:
    """The largest sum of c*log2(c), in millionths, of a window with so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def located(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, found) of the leftmost matches that don't overlap, in code points.

    The pieces between matches and the matches themselves give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found")))).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])).otherwise(none)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _entropic(text: Column, name: str) -> Column:
    """Spans of windows of high entropy in the candidates of a class."""
    pattern, alphabet, bits, needs = CLASSES[name]
    table = F.array(*[F.lit(x).cast("long") for x in TABLE])
    most = limit(bits)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    candidates = F.filter(located(text, pattern), lambda m: ~F.regexp_like(m["found"], F.lit(ALLOWED)) & _all([F.regexp_like(m["found"], F.lit(n)) for n in needs]))

    def place(c: Column) -> Column:
        return F.instr(F.lit(alphabet), c) - 1

    n_words = -(-len(alphabet) // PACKED)

    def scan(m: Column) -> Column:
        places = F.transform(F.filter(F.split(m["found"], ""), lambda c: c != ""), place)
        left = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), places), F.lit(1), F.length(m["found"]))
        steps = F.transform(F.arrays_zip(places.alias("new"), left.alias("old")), lambda x, i: F.struct(i.alias("i"), x["new"].alias("new"), x["old"].alias("old")))
        zero = F.struct(
            *[F.lit(0).cast("long").alias(f"w{j}") for j in range(n_words)], F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("out")
        )

        def count(s: Column, k: Column) -> Column:
            word = s["w0"]
            for j in range(1, n_words):
                word = F.when(k >= j * PACKED, s[f"w{j}"]).otherwise(word)
            return F.call_function("shiftright", word, 5 * (k % PACKED)).bitwiseAND(F.lit(31))

        def bit(k: Column, j: int) -> Column:
            return F.when((k >= j * PACKED) & (k < (j + 1) * PACKED), F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (k % PACKED))).otherwise(F.lit(0).cast("long"))

        def step(s: Column, x: Column) -> Column:
            old, new = x["old"], x["new"]
            less = F.when(old >= 0, count(s, old)).otherwise(F.lit(1).cast("long")).cast("int")
            more = count(s, new).cast("int")
            # The table's first two entries are equal, so nothing is taken off while nothing leaves.
            total = F.when(old == new, s["sum"]).otherwise(s["sum"] - F.get(table, less) + F.get(table, less - 1) + F.get(table, more + 1) - F.get(table, more))
            flag = (x["i"] >= WINDOW - 1) & (total <= most)
            first, last = x["i"] - WINDOW + 1, x["i"] + 1
            apart = flag & (s["lo"] >= 0) & (first > s["hi"])
            return F.struct(
                *[(s[f"w{j}"] + bit(new, j) - bit(old, j)).alias(f"w{j}") for j in range(n_words)], total.alias("sum"),
                F.when(flag & ((s["lo"] < 0) | apart), first).otherwise(s["lo"]).alias("lo"),
                F.when(flag, last).otherwise(s["hi"]).alias("hi"),
                F.when(apart, F.concat(s["out"], F.array(F.struct(s["lo"].alias("start"), s["hi"].alias("end"))))).otherwise(s["out"]).alias("out"),
            )

        def done(s: Column) -> Column:
            return F.when(s["lo"] >= 0, F.concat(s["out"], F.array(F.struct(s["lo"].alias("start"), s["hi"].alias("end"))))).otherwise(s["out"])

        return F.transform(F.aggregate(steps, zero, step, done), lambda e: F.struct((m["start"] + e["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + e["end"]).alias("end")))

    return F.flatten(F.transform(candidates, scan))


def _merged(spans: Column) -> Column:
    """Sorted spans of the entropy kind, overlapping ones as one."""
    none = F.expr(f"cast(array() as {SPAN})")
    span = lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))
    zero = F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        joins = (s["lo"] >= 0) & (x["start"] < s["hi"])
        return F.struct(
            F.when(joins, s["lo"]).otherwise(x["start"]).alias("lo"),
            F.when(joins, F.greatest(s["hi"], x["end"])).otherwise(x["end"]).alias("hi"),
            F.when(joins | (s["lo"] < 0), s["out"]).otherwise(F.concat(s["out"], F.array(span(s["lo"], s["hi"])))).alias("out"),
        )

    return F.aggregate(F.array_sort(spans), zero, step, lambda s: F.when(s["lo"] < 0, s["out"]).otherwise(F.concat(s["out"], F.array(span(s["lo"], s["hi"])))))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (text), span_list (array).

    Places are code points, the end exclusive. A null text counts as empty; texts are searched whole.
    """
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 1)) >= ASSIGN_LEAST)
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", _spans(assign, 0).alias("a"), _spans(located(F.col("text"), ACCESS), 1).alias("b"), _spans(located(F.col("text"), HEX), 2).alias("c"))
    d = d.select("*", F.array_sort(F.concat("a", "b", "c")).alias("base"))
    added = _merged(F.concat(_entropic(F.col("text"), "hex"), _entropic(F.col("text"), "base64")))
    added = F.when(F.regexp_like("text", F.lit(CLASSES["base64"][0])), added).otherwise(F.expr(f"cast(array() as {SPAN})"))
    d = d.select("*", added.alias("added"))
    d = d.withColumn("added", F.filter("added", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    d = d.withColumn("every", F.array_sort(F.concat("base", "added")))
    n = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id", n("a").alias("n_assign"), n("b").alias("n_access"), n("c").alias("n_hex"), n("added").alias("n_entropy"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("every")).alias("spans"), F.col("every").alias("span_list"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = [("assign", 0, ASSIGN), ("access", 1, ACCESS), ("hex", 2, HEX), *((f"e_{k}", 3, v[0]) for k, v in CLASSES.items())]
    runs = " UNION ALL ".join(
        f"SELECT rid, '{name}' AS pat, {kind} AS kind, regexp_extract_all(t, {quote(p)}) AS m, string_split_regex(t, {quote(p)}) AS p FROM d" for name, kind, p in patterns
    )
    needs = " OR ".join(
        f"(pat = 'e_{k}' AND NOT regexp_matches(s, {quote(ALLOWED)}) AND " + " AND ".join(f"regexp_matches(s, {quote(n)})" for n in v[3]) + ")" for k, v in CLASSES.items()
    )
    limits = " ".join(f"WHEN 'e_{k}' THEN {limit(v[2])}" for k, v in CLASSES.items())
    table = "[" + ", ".join(map(str, TABLE[1:])) + "]"
    kinds = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
r AS ({runs}),
x AS (SELECT rid, pat, kind, m, p, unnest(range(1, len(m) + 1)) AS j FROM r WHERE len(m) > 0),
y AS (SELECT rid, pat, kind, m[j] AS s, CAST(list_sum(list_transform(p[1:j], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda v: length(v))), 0) AS INTEGER) AS b FROM x),
base AS (SELECT rid, kind, b, b + length(s) AS e FROM y WHERE kind < 3 AND (kind > 0 OR length(regexp_extract(s, {quote(ASSIGN)}, 1)) >= {ASSIGN_LEAST})),
cand AS (SELECT rid, pat, b, s FROM y WHERE {needs}),
win AS (SELECT rid, pat, b, s, unnest(range(1, length(s) - {WINDOW} + 2)) AS i FROM cand),
chars AS (SELECT rid, pat, b, i, substr(s, i + o.j, 1) AS c, count(*) AS n FROM win, (SELECT unnest(range(0, {WINDOW})) AS j) o GROUP BY ALL),
high AS (SELECT rid, pat, b, i FROM chars GROUP BY ALL HAVING sum(({table})[n]) <= CASE pat {limits} END),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid, pat, b ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM high),
isle AS (SELECT *, sum(new) OVER (PARTITION BY rid, pat, b ORDER BY i) AS g FROM cut),
one AS (SELECT rid, b + min(i) - 1 AS b, b + max(i) - 1 + {WINDOW} AS e FROM isle GROUP BY rid, pat, isle.b, g),
starts AS (SELECT *, CASE WHEN b < max(e) OVER (PARTITION BY rid ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM one),
merged AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM starts),
ent AS (SELECT rid, 3 AS kind, min(b) AS b, max(e) AS e FROM merged GROUP BY rid, g),
added AS (SELECT * FROM ent a WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.rid = a.rid AND s.b < a.e AND a.b < s.e)),
al AS (SELECT rid, kind, b, e FROM base UNION ALL SELECT rid, kind, b, e FROM added),
w AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
  coalesce(string_agg({kinds} || ':' || b || ':' || e, ',' ORDER BY b, kind, e) FILTER (kind < 3), '') AS base, string_agg({kinds} || ':' || b || ':' || e, ',' ORDER BY b, kind, e) AS spans FROM al GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (rid)
"""


SQL = _sql()
