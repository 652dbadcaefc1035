r"""Repair of conversation structure by grammar-compressed dynamic programming.

A conversation should read ``(s?(ua)+)?``: maybe a system turn, then user and
assistant in turn. Every row becomes one symbol: its role's initial, in upper
case where its text is truncated, or ``D`` where it has to go (blank, or said
before). The cheapest edits are a path through a four-state automaton, and the
rows of a stretch act on these states as a 4 x 4 matrix over (min, +).

Symbol strings of many conversations are alike. So pairs of symbols that occur
often become symbols of their own (Re-Pair; ``BATCH`` pairs a round, counted over
all different strings by Spark). A rule's matrix is the product of its two
parts', made once, bottom-up, on the driver: ``ROUNDS * BATCH`` rules at most.
Beside each cost stands a rope: the state between the two parts, so an audit text
is put together only for entries that a result needs. Tasks take the rules with
them and multiply a conversation's few remaining symbols into a state vector.

How it scales: rows are range-partitioned by conversation and turn, so a
conversation with a third of all rows spreads over many tasks; it is cut into
chunks of at most 2 ** ``CHUNK_BITS`` rows. Only symbol strings meet in one task per
conversation, as its audit is one string. Texts are joined to the edits row by row.
The digest of a repaired conversation, being sequential, is streamed.

Defined results: a null id, turn, role or text is written as one space; null ids
are one conversation, null turns come first. Rows of one turn go by role, then by a
hash of role and text; equal rows are numbered. A role whose initial is not s, u or
a (or that is empty) can't be kept. A conversation without rows has an empty
audit. Extra columns are not read. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table

CHUNK_BITS = 10  # a chunk has at most 2 ** CHUNK_BITS rows
ROUNDS, BATCH, FIRST_SYMBOL = 4, 8, 0x100  # rounds of pair counting, rules a round, code point of the first rule
LEAST_COUNT = 2  # occurrences that make a pair worth a rule

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs of edits; the last is added for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role last said
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
TERMINALS = "suaoSUAOD"

SOLVED_SCHEMA = "conv_id long, cost long, audit string, illegal long, has_system boolean, chunks array<struct<chunk:long,blocks:array<string>,lines:array<long>>>"


# ---- the algebra: small, and the same for every conversation


def _inserts() -> list[dict[int, int]]:
    """For each state the states that insertions reach, with their least number."""
    out = []
    for state in range(4):
        reached, last = {state: 0}, {state}
        while last:
            last = {NEXT[r][p] for p in last for r in "ua" if p in NEXT[r]} - reached.keys()
            reached |= {q: max(reached.values()) + 1 for q in last}
        out.append(reached)
    return out


INSERTS = _inserts()


def _terminal(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of one row between two states: insertions before it, then its own edit."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if symbol in "SUAO" else 0
    for p in range(4):
        for q, n in INSERTS[p].items():
            edits = [(q, DELETE, "D")]
            if symbol != "D":
                edits += [(NEXT[r][q], REROLE + extra, "R") for r in "ua" if q in NEXT[r]]
                edits += [(NEXT[r][q], KEEP + extra, "K") for r in [symbol.lower()] if q in NEXT.get(r, {})]
            for to, cost, letter in edits:
                entry = (n * INSERT + cost, "I" * n + letter)
                out[p, to] = min(out.get((p, to), entry), entry)
    return out


class Grammar:
    """Rules ``symbol -> (left, right)`` with a transfer matrix each, and the solver that uses them.

    Of two audits of equal cost for the same rows neither begins the other (the
    longer one would hold more insertions, so cost more): the least audit of the
    whole is made of least audits of the parts.
    """

    def __init__(self) -> None:
        self.rules: list[tuple[str, str, str]] = []
        self.costs: dict[str, dict[tuple[int, int], int]] = {}
        self.texts: dict[tuple[str, int, int], str] = {}
        self.middles: dict[tuple[str, int, int], int] = {}
        for t in TERMINALS:
            entries = _terminal(t)
            self.costs[t] = {pq: c for pq, (c, _) in entries.items()}
            self.texts |= {(t, *pq): a for pq, (_, a) in entries.items()}
        self.known: dict[tuple[str, ...], tuple] = {}

    def add(self, left: str, right: str) -> str:
        """A new rule; its matrix is the product of its parts' matrices."""
        symbol = chr(FIRST_SYMBOL + len(self.rules))
        self.rules.append((symbol, left, right))
        costs: dict[tuple[int, int], int] = {}
        for (p, m), c in self.costs[left].items():
            for (m2, q), d in self.costs[right].items():
                if m2 != m:
                    continue
                best = costs.get((p, q))
                if best is None or c + d < best or c + d == best and self.text(left, p, m) + self.text(right, m, q) < self.text(symbol, p, q):
                    costs[p, q], self.middles[symbol, p, q] = c + d, m
                    self.texts.pop((symbol, p, q), None)
        self.costs[symbol] = costs
        return symbol

    def text(self, symbol: str, p: int, q: int) -> str:
        """The audit of an entry, put together from its rope at first use."""
        key = (symbol, p, q)
        if key not in self.texts:
            _, left, right = self.rules[ord(symbol) - FIRST_SYMBOL]
            m = self.middles[key]
            self.texts[key] = self.text(left, p, m) + self.text(right, m, q)
        return self.texts[key]

    def compressed(self, symbols: str) -> str:
        for symbol, left, right in self.rules:
            symbols = symbols.replace(left + right, symbol)
        return symbols

    def solve(self, parts: tuple[str, ...]) -> tuple[int, list[str]]:
        """(cost, audit of each part) of the cheapest repair; parts are compressed symbol strings, in order."""
        if parts not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[parts] = self._solved(parts)
        return self.known[parts]

    def _solved(self, parts: tuple[str, ...]) -> tuple[int, list[str]]:
        # an entry: (cost, entry before it, text of the last step)
        states: dict[int, tuple] = {START: (0, None, "")}
        for symbol in "".join(parts):
            after: dict[int, tuple] = {}
            for (p, q), cost in self.costs[symbol].items():
                if p in states:
                    entry = (states[p][0] + cost, states[p], (symbol, p, q))
                    if q not in after or self._before(entry, after[q]):
                        after[q] = entry
            states = after
        best = None
        for p, entry in states.items():
            for q, n in INSERTS[p].items():
                if q in ENDS:
                    last = (entry[0] + n * INSERT, entry, "I" * n)
                    best = last if best is None or self._before(last, best) else best
        steps, entry = [], best
        while entry is not None:
            steps.append(self._step(entry))
            entry = entry[1]
        steps = steps[::-1][1:]
        audits, at = [], 0
        for part in parts:
            audits.append("".join(steps[at : at + len(part)]))
            at += len(part)
        audits = audits or [""]
        audits[-1] += steps[-1]
        return best[0], audits

    def _step(self, entry: tuple) -> str:
        return entry[2] if isinstance(entry[2], str) else self.text(*entry[2])

    def _before(self, x: tuple, y: tuple) -> bool:
        """Whether ``x`` is the better of two entries of the same step; texts are compared from where their ways part."""
        if x[0] != y[0]:
            return x[0] < y[0]
        one, two = [self._step(x)], [self._step(y)]
        x, y = x[1], y[1]
        while x is not y:
            one.append(self._step(x))
            two.append(self._step(y))
            x, y = x[1], y[1]
        return "".join(reversed(one)) < "".join(reversed(two))


# ---- rows, symbols, chunks


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows left after the stated damage; nulls written as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _is_truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _keys() -> list[Column]:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2, n): different rows of (conv_id, turn, role, text, copies), with their number."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).select("*", *_keys())


def _same(*names: str, other: str = "_") -> Column:
    """Null-safe equality of columns with those of the other side, which end in ``other``."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(name + other))
    return on


def symbols(different: DataFrame) -> DataFrame:
    """One row of narrow columns for every row of ``turns``, copies included, with its fault, initial and symbol."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    facts = different.select("conv_id", "turn", "role", "h1", "h2", "n", order.alias("at"), _is_blank(F.col("text")).alias("blank"), _is_truncated(F.col("text")).alias("cut"))
    said = facts.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    said = said.select(F.col("conv_id").alias("conv_id_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "first")
    met = facts.join(said, _same("conv_id", "h1", "h2"), "left")
    each = met.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    again = (F.col("copy") > 1) | (F.coalesce(F.col("first"), F.col("at")) < F.col("at"))
    fault = F.when(F.col("blank"), "b").when(again, "d").when(F.col("cut"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    out = each.select("conv_id", "turn", "role", "h1", "h2", "copy", fault.alias("fault"), initial.alias("initial"))
    symbol = F.when(F.col("fault").isin("b", "d"), "D").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return out.withColumn("symbol", symbol)


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` of ``symbols`` in the order of their conversations, each with its place ``pos``; a place tells its chunk by its higher bits."""
    keys = ["conv_id", "turn", "role", "h1", "h2", "copy"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())


def chunked(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, rows, symbols, initials): at most 2 ** CHUNK_BITS rows of a conversation, in order."""
    row = F.struct("pos", "symbol", "initial", "turn", "h1", "h2")
    chunks = rows.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return chunks.select("*", F.array_join("rows.symbol", "").alias("symbols"), F.array_join("rows.initial", "").alias("initials"))


def learnt(chunks: DataFrame, rounds: int = ROUNDS, batch: int = BATCH) -> Grammar:
    """The grammar of the most frequent pairs over all different symbol strings; ``batch`` counts a round reach the driver."""
    grammar, strings = Grammar(), saved(chunks.select("symbols").distinct(), "symbol-strings")
    for _ in range(rounds):
        pairs = F.transform(F.sequence(F.lit(1), F.length("symbols") - 1), lambda i: F.col("symbols").substr(i, F.lit(2)))
        counts = strings.where(F.length("symbols") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        found = counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "pair").limit(batch).collect()
        if not found:
            break
        for r in found:
            symbol = grammar.add(*r.pair)
            strings = strings.select(F.replace("symbols", F.lit(r.pair), F.lit(symbol)).alias("symbols"))
    return grammar


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _row_blocks(audit: str) -> Iterator[str]:
    """The audit cut behind each row's letter; insertions at the end stay with the last row."""
    at, last = 0, len(audit.rstrip("I")) - 1
    for end, letter in enumerate(audit):
        if end == last:
            yield audit[at:]
            return
        if letter != "I":
            yield audit[at : end + 1]
            at = end + 1


def _solver(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("conv_id", "cost", "audit", "illegal", "has_system", "chunks")}
            for row in batch.to_pylist():
                parts = tuple(grammar.compressed(c["symbols"]) for c in row["parts"])
                cost, audits = grammar.solve(parts)
                line, chunks = 0, []
                first = next((i for i, x in enumerate("".join(audits).replace("I", "")) if x != "D"), None)
                whole = "".join(audits)
                symbols = "".join(c["symbols"] for c in row["parts"])
                has_system = first is not None and whole[: first + 1] == "D" * first + "K" and symbols[first] in "sS"
                for c, audit in zip(row["parts"], audits, strict=True):
                    blocks, lines = list(_row_blocks(audit)), []
                    for b in blocks:
                        lines.append(line)
                        line += len(b) - b.count("D")
                    chunks.append({"chunk": c["chunk"], "blocks": blocks, "lines": lines})
                values = (row["conv_id"], cost, whole, _illegal("".join(c["initials"] for c in row["parts"])), has_system, chunks)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            part = pa.struct([("chunk", pa.int64()), ("blocks", pa.list_(pa.string())), ("lines", pa.list_(pa.int64()))])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(part))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def solved(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """Cost, audit and edits of every conversation in ``chunks``; one row each, of symbol strings only."""
    part = F.struct("chunk", "symbols", "initials")
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return ship(whole).mapInArrow(_solver(grammar), SOLVED_SCHEMA)


# ---- edits back to texts


def _role_at(line: Column) -> Column:
    return F.when((line - F.col("has_system").cast("int")) % 2 == 0, "user").otherwise("assistant")


def repaired(different: DataFrame, chunks: DataFrame, solutions: DataFrame) -> DataFrame:
    """(conv_id, line, role, text, edit): the repaired conversations, their lines counted from 0; edit is K, R or I."""
    edits = solutions.select("conv_id", "has_system", F.explode("chunks").alias("c"))
    edits = edits.select(F.col("conv_id").alias("conv_id_"), "has_system", F.col("c.chunk").alias("chunk_"), F.col("c.blocks").alias("blocks"), F.col("c.lines").alias("lines"))
    rows = chunks.join(edits, _same("conv_id", "chunk")).select("conv_id", "has_system", F.explode(F.arrays_zip("rows", "blocks", "lines")).alias("r"))
    rows = rows.select("conv_id", "has_system", "r.rows.turn", "r.rows.h1", "r.rows.h2", F.col("r.blocks").alias("block"), F.col("r.lines").alias("line"))
    rows = rows.where(F.col("block") != "D")
    own = different.select(F.col("conv_id").alias("conv_id_"), F.col("turn").alias("turn_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "role", "text")
    met = rows.join(own, _same("conv_id", "turn", "h1", "h2"))
    line = F.col("line") + F.col("i")
    letters = F.split(F.replace("block", F.lit("D"), F.lit("")), "")
    each = met.select("conv_id", "has_system", "line", "role", "text", F.posexplode(letters).alias("i", "edit")).where("edit <> ''")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(_role_at(line))
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return each.select("conv_id", line.alias("line"), role.alias("role"), text.alias("text"), "edit")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each run of equal ids, over the lines as they stream by."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    at, digest = None, None
    for batch in batches:
        ids, found = [], []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("said"), strict=True):
            line = line.as_py().encode()
            if digest is None or conv != at:
                if digest is not None:
                    ids.append(at)
                    found.append(digest.hexdigest())
                at, digest = conv, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=schema)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` lines joined by \\n. A digest is sequential: one task streams a conversation, holding a batch at a time."""
    said = lines.select("conv_id", "line", F.concat("role", F.lit(":"), "text").alias("said"))
    return ship(said.repartition("conv_id").sortWithinPartitions("conv_id", "line")).mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation in ``rows`` of ``symbols``."""
    count = lambda kind: F.count_if(F.col("fault") == kind)
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn"), F.lit(0))
    return rows.groupBy("conv_id").agg(gaps.try_cast("long").alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faults, solutions, repaired lines) of (conv_id, turn, role, text, copies) rows."""
    different = saved(turns(rows), "turns")
    placed = saved(ordered(symbols(different)), "ordered-turns")
    chunks = saved(chunked(placed), "turn-chunks")
    solutions = saved(solved(chunks, learnt(chunks)), "repairs")
    return faults(placed), solutions, repaired(different, chunks, solutions)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations")
    found, solutions, lines = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    under = lambda df: df.withColumnRenamed("conv_id", "conv_id_")
    out = ids.join(under(found), _same("conv_id"), "left").drop("conv_id_")
    out = out.join(under(solutions.select("conv_id", "cost", "audit", "illegal")), _same("conv_id"), "left").drop("conv_id_")
    out = out.join(under(digests(lines)), _same("conv_id"), "left").drop("conv_id_")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


QUERIES = {"op11_repair": op11_repair}

# every state's cheapest (cost, audit) carried from row to row
ORACLES = {
    "op11_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(unicode(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))),
    CAST(4294967295 AS BIGINT)) % 20 AS kind FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), faulty AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), r AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS init, body = '' AS blank, body <> '' AND nth > 1 AS again,
         body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS step FROM faulty
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': ''} AS z, {'c': CAST(1000000 AS BIGINT), 'a': ''} AS s,
         {'c': CAST(1000000 AS BIGINT), 'a': ''} AS u, {'c': CAST(1000000 AS BIGINT), 'a': ''} AS a
  FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, {'c': z.c + 3, 'a': z.a || 'D'},
         list_min([{'c': s.c + 3, 'a': s.a || 'D'}, {'c': CASE WHEN init = 's' AND NOT gone THEN z.c + t ELSE 2000000 END, 'a': z.a || 'K'}]),
         list_min([{'c': u.c + 3, 'a': u.a || 'D'}, {'c': CASE WHEN init = 'u' AND NOT gone THEN toward_u.c + t ELSE 2000000 END, 'a': toward_u.a || 'K'},
                   {'c': CASE WHEN gone THEN 2000000 ELSE toward_u.c + t + 2 END, 'a': toward_u.a || 'R'}]),
         list_min([{'c': a.c + 3, 'a': a.a || 'D'}, {'c': CASE WHEN init = 'a' AND NOT gone THEN u.c + t ELSE 2000000 END, 'a': u.a || 'K'},
                   {'c': CASE WHEN gone THEN 2000000 ELSE u.c + t + 2 END, 'a': u.a || 'R'}])
  FROM (
    SELECT conv_id, i, init, gone, t, z, s, list_min([u, iu]) AS u, list_min([a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': iu.c + 2, 'a': iu.a || 'I'}]) AS a,
           list_min([z, s, list_min([a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': iu.c + 2, 'a': iu.a || 'I'}])]) AS toward_u
    FROM (
      SELECT dp.conv_id, r.i, r.init, r.blank OR r.again AS gone, CASE WHEN r.cut THEN 1 ELSE 0 END AS t, z, s, u, a,
             {'c': list_min([z, s, a]).c + 2, 'a': list_min([z, s, a]).a || 'I'} AS iu
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))
), best AS (
  SELECT conv_id, list_min([z, a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}]) AS b
  FROM dp WHERE i = (SELECT max(i) FROM r WHERE r.conv_id IS NOT DISTINCT FROM dp.conv_id)
), letters AS (
  SELECT conv_id, p, substr(b.a, p, 1) AS letter FROM best, unnest(range(1, len(b.a) + 1)) t(p)
), placed AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
         sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) - 1 AS line FROM letters
), said AS (
  SELECT placed.conv_id, p, letter, line, r.role, r.text,
         bool_or(line = 0 AND letter = 'K' AND r.init = 's') OVER (PARTITION BY placed.conv_id) AS has_s
  FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.i = placed.i WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - has_s::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
                             CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM said GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate,
         count_if(cut) AS truncated, count_if(step NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts y ON y.conv_id IS NOT DISTINCT FROM o.conv_id
"""
}
