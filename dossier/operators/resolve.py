"""Person resolution: mentions of a matter become canonical people.

The ordered fold reads mentions sorted by matter, document, page (none first) and id, many matters in one stream, and keeps
only the people of the current matter. A mention takes the first person, in order of creation, that its strict form equals,
shares a token subset with or matches by last name; else the one with the best fuzzy score of at least 0.85, unless an
embedding of the names (a pluggable column function) scores higher from 0.92; else, of the three best doubtful ones (fuzzy
from 0.70, embedding from 0.85), the first that a pluggable verdict confirms; else it founds a person. A longer spelling
replaces a person's name. What a form was given is remembered until a name changes or a person comes, so a matter of very
many mentions costs a look-up for most of them. The fold of one matter is sequential by definition: beyond that, linked()
is the form without an order.

Defined results: mentions without a name or a matter take no part; a name without anything left in its strict form matches
such names only; rows that repeat, and rows without an id or with one id, are mentions of their own, as all columns of a mention go
through the stream with it; extra columns are kept, but those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import fixed, rules
from dossier.functions import names as N
from dossier.functions.text import relevance_rank
from dossier.operators import seeds
from dossier.operators.components import connected_components
from dossier.sources.shared import materialize

FOUND = T.StructType().add("form", "string").add("person", "integer").add("match_type", "string").add("match_score", "double").add("match_reason", "string")
#: Is the new mention (name, role, observation) the known person (name, role, observation of the founder)? With confidence, and a reason if it has one.
Verdict = Callable[[dict, dict], tuple[bool, float] | tuple[bool, float, str]]


def excluded(mentions: DataFrame, firm_domain: str | None = None) -> DataFrame:
    """Mentions without the firm's own staff and attorneys of record."""
    out = mentions if firm_domain is None else mentions.where(~rules.own_staff(F.col("email"), F.lit(firm_domain)))
    return out.where(~rules.attorney_rule(F.col("role"), F.col("observation"))["exclude"])


@lru_cache(100_000)
def tier(a: str, b: str) -> tuple[str, float] | None:
    """The rule tier by which two strict forms are one person, else None."""
    if a == b:
        return "exact", 1.0
    s, t = a.split(), b.split()
    x, y = set(s), set(t)
    if len(x) > 1 and len(y) > 1 and (x <= y or y <= x):
        return "token_subset", fixed.SUBSET_SCORE
    if len(s) < 2 or len(t) < 2 or s[-1] != t[-1]:
        return None
    x, y, unknown = set(s[:-1]), set(t[:-1]), set(fixed.UNKNOWN_NAMES)
    if (x & unknown and y - unknown) or (y & unknown and x - unknown):
        return "lastname_priority", fixed.PLACEHOLDER_SCORE
    variants = lambda names: {v for n in names for v in fixed.NICKNAMES.get(n, (n,))}
    alike = any(variants([p]) & variants([q]) for p in x for q in y)
    return ("lastname_priority", fixed.LASTNAME_SCORE) if x & y or alike else None


@lru_cache(100_000)
def fuzzy_of(a: str, b: str) -> float:
    longest = max(len(a), len(b)) or 1
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    edits = 1.0 if a == b else 0.0 if not a or not b else 1 - row[-1] / longest
    return 0.6 * N.jaro_winkler_of(a, b) + 0.4 * edits


#: Up to so many spellings, their vectors are sent to the tasks; beyond, they go with the first mention of a form.
FEW_SPELLINGS = 5_000


class Vector:
    """A vector with its norm; of those that a task keeps for all matters, cosines are remembered."""

    def __init__(self, values) -> None:
        self.values = np.asarray(values, np.float64)
        self.norm = np.linalg.norm(self.values)


@lru_cache(20_000)
def cosine(a: Vector, b: Vector) -> float | None:
    size = float(a.norm * b.norm)
    return float(a.values @ b.values) / size if size else None


class People:
    """The people of one matter, in order of creation, and what each form was given since the last change."""

    def __init__(self, verdict: Verdict | None) -> None:
        self.verdict, self.people, self.known, self.vectors = verdict, [], {}, {}

    def _nearest(self, form: str, found: tuple | None, doubtful: list) -> tuple | None:
        """The embedding tier: better than the fuzzy score found so far, or doubtful."""
        mine = self.vectors.get(form)
        if mine is None or (found is not None and found[2] >= fixed.EMBEDDING_MATCH):
            return found
        fuzzy_person, best = (found[0], found[2]) if found else (None, 0.0)
        for i, p in enumerate(self.people):
            other = self.vectors.get(p["form"])
            score = None if other is None or i == fuzzy_person else cosine(mine, other)
            if score is None:
                continue
            if score >= fixed.EMBEDDING_MATCH and score > best:
                found, best = (i, "embedding", score), score
            elif score >= fixed.EMBEDDING_UNCERTAIN:
                doubtful.append((score, i))
        return found

    def _match(self, form: str, new: dict) -> tuple | None:
        found, doubtful = None, []
        for i, p in enumerate(self.people):
            if hit := tier(form, p["form"]):
                return i, *hit
            score = fuzzy_of(form, p["form"])
            if score >= fixed.FUZZY_MATCH and score > (found[2] if found else 0.0):
                found = (i, "fuzzy", score)
            elif score >= fixed.FUZZY_UNCERTAIN:
                doubtful.append((score, i))
        found = self._nearest(form, found, doubtful)
        if found is None and self.verdict is not None:
            for score, i in sorted(doubtful, key=lambda x: -x[0])[:3]:
                same, sure, *why = self.verdict(new, {k: self.people[i][k] for k in ("name", "role", "observation")})
                if same and sure >= fixed.VERDICT:
                    return i, "verified", (score + sure) / 2, *why
        return found

    def add(self, form: str, name: str, role: str | None, observation: str | None, vector) -> tuple:
        """(person, how, score, reason) of the next mention; only a verdict has a reason."""
        if vector is not None and form not in self.vectors:
            self.vectors[form] = vector if isinstance(vector, Vector) else Vector(vector)
        new = {"name": name, "role": role, "observation": observation}
        key = form if self.verdict is None else (form, role, observation)
        if key not in self.known:
            self.known[key] = self._match(form, new)
        found = self.known[key]
        if found is None:
            self.people.append({"form": form} | new)
            self.known = {}
            return len(self.people) - 1, "none", 0.0, None
        person = self.people[found[0]]
        if len(name) > len(person["name"]):
            if form != person["form"]:
                self.known = {}
            person["form"], person["name"] = form, name
        return (*found, None)[:4]


def _matters(df: DataFrame, order: list[str], needs: list[str], run: Callable, add: T.StructType, drop: list[str]) -> DataFrame:
    """df less `drop`, with the columns `add` that run() gives for each row: a function of the columns `needs`, new for each
    matter, over its rows in order. Many matters come in one stream; the other columns pass through as they are."""
    kept = [f for f in df.schema.fields if f.name not in drop]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, work = object(), None
        for batch in batches:
            table, out = pa.Table.from_batches([batch]), []
            for matter, *values in zip(*[table[c].to_pylist() for c in ("matter_id", *needs)], strict=True):
                if matter != last:
                    last, work = matter, run()
                out.append(work(*values))
            found = zip(*out, strict=True) if out else [()] * len(add)
            columns = [table[f.name].combine_chunks() for f in kept] + [pa.array(list(x), _ARROW[f.dataType.simpleString()]) for f, x in zip(add.fields, found, strict=True)]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], [f.name for f in kept] + add.names)

    return df.repartition("matter_id").sortWithinPartitions("matter_id", *order).mapInArrow(stream, T.StructType(kept + add.fields))


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def forms(mentions: DataFrame, compat: bool = False, spelt: DataFrame | None = None) -> DataFrame:
    """mentions with their strict form; names are normalised once for each different spelling.

    The spellings are written: otherwise a condition on forms moves below the distinct, and all rows are normalised. spelt: a table with all
    spellings (and maybe more), where one is at hand that costs less than mentions.
    """
    return mentions.join(_spellings(mentions if spelt is None else spelt, lambda c: N.strict(c, compat)), "full_name")


def _spellings(mentions: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    return materialize(mentions.where("full_name IS NOT NULL").select("full_name").distinct().withColumn("form", form(F.col("full_name"))), "spellings")


def resolved(mentions: DataFrame, compat: bool = False, verdict: Verdict | None = None, embed: Callable[[Column], Column] | None = None, spelt: DataFrame | None = None) -> DataFrame:
    """mentions (id, matter_id, document_id, source_page, full_name, and role and observation for a verdict) with form, person
    (0, 1, .. in each matter) and how it matched. embed: a column function from names to vectors; it runs once a spelling. spelt: see forms().

    All columns go through the stream, so callers with large tables select those that they need."""
    rows = forms(mentions.where("matter_id IS NOT NULL").drop(*FOUND.names), compat, spelt).withColumnRenamed("form", "__form").withColumn("__page", F.coalesce("source_page", F.lit(-1)))
    order, told = ["document_id", "__page", "id"], ["role", "observation"] if verdict else []
    needs, few = ["__form", "full_name", *told], {}
    if embed is not None:
        vectors = materialize((mentions if spelt is None else spelt).where("full_name IS NOT NULL").select("full_name").distinct().withColumn("__vector", embed(F.col("full_name"))), "vectors")
        if vectors.count() <= FEW_SPELLINGS:  # then they go to the tasks at once, not with the rows
            few = {r["full_name"]: Vector(r["__vector"]) for r in vectors.collect() if r["__vector"] is not None}
        else:
            first = F.row_number().over(Window.partitionBy("matter_id", "__form").orderBy(*order)) == 1
            rows = rows.withColumn("__first", first).join(vectors, "full_name").withColumn("__vector", F.when(F.col("__first"), F.col("__vector")))
            needs.append("__vector")

    def run():
        people = People(verdict)

        def work(form, name, *more):
            role, observation = more[:2] if told else (None, None)
            vector = few.get(name) if few else more[-1] if needs[-1] == "__vector" else None
            return form, *people.add(form, name, role, observation, vector)

        return work

    # Of mentions with one place the name, role and observation decide, so the order does not depend on the layout.
    order = [*order, "full_name", *told]
    return _matters(rows, order, needs, run, FOUND, ["__form", "__page", "__first", "__vector"])


def canonical_people(found: DataFrame) -> DataFrame:
    """One row for each person of resolved mentions, as if each had been merged into the person in order.

    The longest name (the earliest of equals), the role of the first mention, the highest relevance with its reason (a first
    mention without one counts as relevant), the first non-empty contacts, the highest confidence. `observations` counts
    those of merged_observations(); `source_documents` counts the mentions whose document had shown no observation before.
    """
    key, order = ["matter_id", "person"], F.struct("document_id", F.coalesce("source_page", F.lit(-1)).alias("page"), "id")
    told = F.coalesce(F.col("observation"), F.lit("")) != ""
    before = Window.partitionBy(*key, "document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.first("place").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("place", order).withColumn("start", start)  # first: its shuffle serves all that follows, and the fold runs once
    rows = rows.withColumns({"told": told, "new": ~F.coalesce(F.max(told).over(before), F.lit(False))})
    rank = relevance_rank(F.when(F.col("place") == F.col("start"), F.when(relevance_rank(F.col("relevance")) < 0, "relevant").otherwise(F.col("relevance"))).otherwise(F.col("relevance")))
    rows = rows.withColumn("rank", rank)
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("place"))).alias(c)
    best = F.max(F.struct("rank", *[(-F.col(f"place.{c}")).alias(c) for c in ("document_id", "page", "id")], "relevance_reason"))
    people = rows.groupBy(*key).agg(
        F.max(F.struct(F.length("full_name"), *[(-F.col(f"place.{c}")).alias(c) for c in ("document_id", "page", "id")], "full_name"))["full_name"].alias("full_name"),
        F.min_by("role", "place").alias("role"), best.alias("best"), filled("email"), filled("phone"), filled("address"),
        F.max("confidence_score").alias("max_confidence"), F.count_if(F.col("told") & F.col("new")).alias("observations"), F.count_if("new").alias("source_documents"), F.count("*").alias("mentions"),
    )
    relevance = F.element_at(F.array(*map(F.lit, fixed.RELEVANCE)), (F.col("best.rank") + 1).cast("int"))
    return people.withColumns({"relevance": relevance, "relevance_reason": F.col("best.relevance_reason")}).drop("best")


def merged_observations(found: DataFrame) -> DataFrame:
    """(matter_id, person, document_id, source_page, observation): the first observation of each document of a person."""
    told = found.where(F.coalesce(F.col("observation"), F.lit("")) != "")
    place = F.struct(F.coalesce("source_page", F.lit(-1)).alias("page"), "id")
    return told.groupBy("matter_id", "person", "document_id").agg(F.min_by(F.struct("source_page", "observation"), place).alias("o")).select("matter_id", "person", "document_id", "o.*")


def loose_clusters(mentions: DataFrame, least: int = fixed.LOOSE_MATCH, small: int = seeds.SMALL, block: int = seeds.BLOCK, spelt: DataFrame | None = None) -> DataFrame:
    """mentions with cluster: greedy seeds. The next free loose form seeds a cluster; later free forms join if they match the seed.

    Forms come in the order of their least mention id; clusters are numbered in the order of their seeds. See seeds for how a matter of
    very many forms is dealt over tasks. Forms without an id come first.
    """
    spellings = _spellings(mentions if spelt is None else spelt, N.loose)
    named = mentions.drop("form", "cluster").where("matter_id IS NOT NULL").join(spellings, "full_name")
    few = materialize(named.groupBy("matter_id", "form").agg(F.min("id").alias("place")), "forms")
    found = materialize(seeds.seeds(few, least, small, block), "found")
    numbered = few.join(found.where("form = seed").select("matter_id", "form"), ["matter_id", "form"])  # a row for each seed
    number = F.row_number().over(Window.partitionBy("matter_id").orderBy(F.col("place").asc_nulls_first(), "form")) - 1
    numbered = numbered.select("matter_id", F.col("form").alias("seed"), number.alias("cluster"))
    return named.join(found.join(numbered, ["matter_id", "seed"]).drop("seed"), ["matter_id", "form"])


def stats(found: DataFrame) -> DataFrame:
    """(matter_id, mentions, people, merged_share): share of mentions that founded no person, in percent."""
    n = F.count_distinct("person")
    return found.groupBy("matter_id").agg(F.count("*").alias("mentions"), n.alias("people"), F.round((1 - n / F.count("*")) * 100, 1).alias("merged_share"))


#: Matters of up to so many forms are linked in the stream that reads them; a larger one by joins over many tasks.
SMALL = 1_000


@lru_cache(20_000)
def _keys(form: str) -> tuple[str, frozenset, frozenset] | None:
    """Last name, variants of the other names (none: a placeholder) and tokens of a form, which linked() goes by; None for less than two tokens."""
    *given, last = [x for x in form.split(" ") if x] or [""]
    real = set(given) - set(fixed.UNKNOWN_NAMES)
    return (last, frozenset(v for x in real for v in fixed.NICKNAMES.get(x, (x,))), frozenset([*given, last])) if given else None


def linked_forms(forms: list[str]) -> list[int]:
    """What linked() finds among the different forms of one matter, in the order of their hashes: for each the number of the first form of its person."""
    root = list(range(len(forms)))

    def first(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def link(i: int, j: int) -> None:
        i, j = first(i), first(j)
        root[max(i, j)] = min(i, j)

    keys = [_keys(f) for f in forms]
    several = [(i, *k) for i, k in enumerate(keys) if k]
    by_name, known, holders, parts = {}, {}, defaultdict(list), {}
    for i, last, variants, tokens in several:
        for v in variants:
            link(i, by_name.setdefault((last, v), i))
        if variants:
            known.setdefault(last, i)
        if len(tokens) > 1:
            parts.setdefault(tokens, i)
            for x in tokens:
                holders[x].append(i)
    for i, last, variants, _ in several:
        if not variants and last in known:
            link(i, known[last])
    for part, i in parts.items():
        for j in min((holders[x] for x in part), key=len):
            if part <= keys[j][2]:
                link(i, j)
    return [first(i) for i in range(len(forms))]


def _streamed(rows: DataFrame, schema: T.StructType, run: Callable) -> DataFrame:
    """What run(), new for each matter, makes of rows (matter_id and others, a matter's rows in one task and in order): add() takes the other
    values of each, then end(matter) gives rows of the result. Many matters come in one stream."""
    names = rows.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, work, kind = None, None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind if f.name == "matter_id" else _ARROW[f.dataType.simpleString()]) for f, x in zip(schema, columns, strict=True)], schema.names)

        for batch in batches:
            out, kind = [], batch["matter_id"].type
            for matter, *values in zip(*[batch[c].to_pylist() for c in names], strict=True):
                if work is None or matter != last:
                    out += work.end(last) if work else []
                    last, work = matter, run()
                work.add(*values)
            if out:
                yield batch_of(out)
        if work and (out := work.end(last)):
            yield batch_of(out)

    return rows.mapInArrow(stream, schema)


class _Linked:
    """linked() of one matter's forms, in the order of their nodes; those of a large matter are given back without a person."""

    def __init__(self, small: int) -> None:
        self.small, self.nodes, self.forms = small, [], []

    def add(self, node: int, form: str) -> None:
        self.nodes.append(node)
        self.forms.append(form)

    def end(self, matter) -> list[tuple]:
        found = [self.nodes[i] for i in linked_forms(self.forms)] if len(self.forms) <= self.small else [None] * len(self.forms)
        return [(matter, *row) for row in zip(self.nodes, self.forms, found, strict=True)]


def linked(mentions: DataFrame, spelt: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """Scale mode for matters with very many names: (id, matter_id, form, person) by the rule tiers alone, transitively.

    Forms that share the last name and a variant of another name are one person by the last-name tier, whichever two are
    taken, so each such key links its forms to its least one: no pairs are formed. A token set meets the forms that hold the
    rarest of its tokens (in its matter), and those that hold all of its tokens are linked to it, however long they are.
    People are the connected components; person is the least form hash of one. Placeholders (unknown first names) join the
    least form of their last name. No fuzzy tier; the ordered fold stays the reference. Matters of up to `small` forms are
    linked in one stream, larger ones by joins and rounds over all tasks.
    """
    named = forms(mentions, spelt=spelt)
    people = _people(named.select("matter_id", "form").distinct(), small)
    return named.join(people, ["matter_id", "form"], "left").select("id", "matter_id", "form", "person")


def _people(few: DataFrame, small: int) -> DataFrame:
    """(matter_id, form, person) of different forms (matter_id, form), none for the empty form: see linked()."""
    few = few.where("form <> '' AND matter_id IS NOT NULL").withColumn("node", F.xxhash64("matter_id", "form"))
    done = None
    if small:
        rows = few.select("matter_id", "node", "form").repartition("matter_id").sortWithinPartitions("matter_id", "node", "form")
        found = materialize(_streamed(rows, T.StructType([*rows.schema]).add("person", "long"), lambda: _Linked(small)), "linked")
        done, few = found.where("person IS NOT NULL").drop("node"), found.where("person IS NULL").drop("person")
        if few.isEmpty():
            return done
    few = materialize(few.withColumn("t", N.tokens(F.col("form"))), "forms")
    given = F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))
    unknown = F.array(*map(F.lit, fixed.UNKNOWN_NAMES))
    table = F.create_map(*[x for k, v in fixed.NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    real = F.array_except(given, unknown)
    variants = F.array_distinct(F.flatten(F.transform(real, lambda x: F.coalesce(table[x], F.array(x)))))
    several = few.where(F.size("t") > 1).withColumn("last", F.element_at("t", -1))
    by_name = several.select("matter_id", "node", "last", F.explode(variants).alias("key"))
    stars = by_name.groupBy("matter_id", "last", "key").agg(F.min("node").alias("v")).join(by_name, ["matter_id", "last", "key"]).select(F.col("node").alias("u"), "v")
    known = several.where(F.size(real) > 0).groupBy("matter_id", "last").agg(F.min("node").alias("v"))
    wild = several.where(F.arrays_overlap(given, unknown) & (F.size(real) == 0)).join(known, ["matter_id", "last"]).select(F.col("node").alias("u"), "v")
    sets = several.select("matter_id", "node", F.array_sort(F.array_distinct("t")).alias("set"))
    holders = sets.select("matter_id", "node", "set", F.explode("set").alias("token"))
    often = holders.groupBy("matter_id", "token").agg(F.count("*").alias("n"))
    rarest = holders.join(often, ["matter_id", "token"]).groupBy("matter_id", "set").agg(F.min("node").alias("v"), F.min_by("token", F.struct("n", "token")).alias("token"))
    rarest = rarest.where(F.size("set") > 1).withColumnRenamed("set", "part")
    inside = holders.where(F.size("set") > 1).join(rarest, ["matter_id", "token"]).where(F.size(F.array_except("part", "set")) == 0).select(F.col("node").alias("u"), "v")
    edges = stars.unionByName(wild).unionByName(inside)
    found = connected_components(edges)
    people = few.join(found, "node", "left").select("matter_id", "form", F.coalesce("component", "node").alias("person"))
    return people if done is None else done.unionByName(people)


def placed(mentions: DataFrame) -> DataFrame:
    """mentions (document_id, full_name) with their place in the document as id, and without a page: in the same order as by page and id, but
    small, for those that only need the order. Documents shuffled for it stay where a join on document_id looks for them."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.coalesce("source_page", F.lit(-1)), "id", "full_name"))
    return mentions.select("document_id", "full_name", place.alias("id"), F.lit(None).cast("int").alias("source_page"))


class _Compared:
    """The fold of one matter, counted by form and person, and how far linked() agrees; a large matter gives its counts."""

    def __init__(self, small: int) -> None:
        self.small, self.people, self.counts, self.nodes = small, People(None), Counter(), {}

    def add(self, form: str, name: str, node: int) -> None:
        self.counts[form, self.people.add(form, name, None, None, None)[0]] += 1
        self.nodes[form] = node

    def end(self, matter) -> list[tuple]:
        forms = sorted((f for f in self.nodes if f), key=self.nodes.get)
        if len(forms) > self.small:
            return [(matter, f, p, n, None, None, None) for (f, p), n in self.counts.items()]
        of_form, cells, in_a, in_b = dict(zip(forms, linked_forms(forms), strict=True)), Counter(), Counter(), Counter()
        for (form, p), n in self.counts.items():
            q = of_form.get(form)
            for counter, key in ((cells, (p, q)), (in_a, p), (in_b, q)):
                counter[key] += n
        same = sum(n for (p, q), n in cells.items() if n == in_a[p] == in_b[q])
        return [(matter, None, None, sum(cells.values()), len(in_a), len(in_b.keys() - {None}), same)]


def compared(mentions: DataFrame, spelt: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """agreement() of resolved() and linked() over all mentions, each counted once whatever its id: (matter_id, people_a, people_b, same).

    Mentions are shuffled by matter once: what linked() finds hangs on the form alone, so it is compared with the fold's people by form, and nothing is
    joined back. Matters of up to `small` forms are linked where they are folded; of larger ones, the counts by form and person are left.
    """
    rows, spellings = mentions.where("matter_id IS NOT NULL").select("matter_id", "document_id", "source_page", "id", "full_name"), _spellings(mentions if spelt is None else spelt, N.strict)
    if spellings.count() <= FEW_SPELLINGS:  # then forms are not shuffled
        rows = rows.repartition("matter_id").join(F.broadcast(spellings), "full_name")
    else:
        rows = rows.join(spellings, "full_name").repartition("matter_id")
    rows = rows.sortWithinPartitions("matter_id", "document_id", F.coalesce("source_page", F.lit(-1)), "id", "full_name").select("matter_id", "form", "full_name", F.xxhash64("matter_id", "form").alias("node"))
    schema = T.StructType([rows.schema["matter_id"]]).add("form", "string").add("p", "integer").add("n", "long").add("people_a", "long").add("people_b", "long").add("same", "long")
    found = materialize(_streamed(rows, schema, lambda: _Compared(small)), "compared")
    done = found.where("people_a IS NOT NULL").select("matter_id", "people_a", "people_b", F.round(F.col("same") / F.col("n"), 4).alias("same"))
    left = found.where("people_a IS NULL").select("matter_id", "form", "p", "n")
    if left.isEmpty():
        return done
    people = _people(left.select("matter_id", "form").distinct(), 0).withColumnRenamed("person", "q")
    cells = left.join(people, ["matter_id", "form"], "left").groupBy("matter_id", "p", "q").agg(F.sum("n").alias("n"))
    return done.unionByName(_agreement(cells))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(matter_id, people_a, people_b, same): the share of mentions whose person has the same members in both results.

    Counted over the different (person of a, person of b) combinations: a person is the same when its only combination
    holds all mentions of either side.
    """
    both = a.select("id", "matter_id", F.col("person").alias("p")).join(b.select("id", F.col("person").alias("q")), "id")
    return _agreement(both.groupBy("matter_id", "p", "q").agg(F.count("*").alias("n")))


def _agreement(cells: DataFrame) -> DataFrame:
    cells = materialize(cells, "cells")  # read three times
    of_a = cells.groupBy("matter_id", "p").agg(F.sum("n").alias("in_a"))
    of_b = cells.groupBy("matter_id", "q").agg(F.sum("n").alias("in_b"))
    joined = cells.join(of_a, ["matter_id", "p"]).join(of_b.withColumnRenamed("q", "r").withColumnRenamed("matter_id", "m"), (F.col("matter_id") == F.col("m")) & F.col("q").eqNullSafe(F.col("r")))
    equal = F.when((F.col("n") == F.col("in_a")) & (F.col("n") == F.col("in_b")), F.col("n")).otherwise(0)
    return joined.groupBy("matter_id").agg(F.count_distinct("p").alias("people_a"), F.count_distinct("q").alias("people_b"), F.round(F.sum(equal) / F.sum("n"), 4).alias("same"))
