"""Structures written as text: component columns, composition counts, molecular graphs, classes.

A bounded reader of the SMILES notation (organic subset, brackets, bonds, branches, rings, dots), a fold in
column expressions, gives atoms, bonds and rings. What needs a chemistry library is named in ``capabilities`` as unavailable.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composition_key, split_fragments
from .perception import let, perceived

# Standard atomic weights of the elements that the reader knows, and usual valences.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Br": 79.904, "I": 126.904}
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}
ORDERS = {"-": 1, "=": 2, "#": 3, ":": 1, "/": 1, "\\": 1}
# Places of an atom's symbol among its features, and numbers of the elements that the reader knows.
ATOM_SYMBOLS = ["C", "N", "O", "S", "F", "Si", "P", "Cl", "Br", "I", "B", "H", "Fe", "Zn", "Cu", "Mn", "Unknown"]
NUMBERS = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Br": 35, "I": 53}
#: A token; a bracket atom: isotope, symbol, chirality, hydrogens, charge, class.
TOKEN = r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|\d|[-=#:/\\().]"
BRACKET = r"\[(\d*)([A-Za-z][a-z]?)(@*)(H\d*)?([+-]\d*|\++|-+)?(?::\d+)?\]"

#: What each optional feature needs.
NEEDS = {
    "all 2-D descriptors": "rdkit", "3-D descriptors": "rdkit", "extended descriptors": "mordred",
    "language-model embeddings": "transformers", "force-field energies": "torchani", "graph networks": "torch_geometric", "higher homology": "ripser",
    "image recognition": "tensorflow", "PDF pages": "fitz", "XGBoost": "xgboost", "LightGBM": "lightgbm", "CatBoost": "catboost", "TabPFN": "tabpfn", "AutoGluon": "autogluon",
}


def capabilities() -> list[tuple[str, bool, str]]:
    """(feature, available, reason) of everything optional."""
    found = {n: importlib.util.find_spec(n) is not None for n in set(NEEDS.values())}
    return [(f, found[n], "" if found[n] else f"the package {n} is not installed") for f, n in NEEDS.items()]


def capability_table(spark) -> DataFrame:
    return spark.createDataFrame(capabilities(), "feature string, available boolean, reason string")


def split_column(df: DataFrame, column: str, most: int = 6) -> DataFrame:
    """``<column>_1..k``, ``_n_components`` (of all) and ``_key`` from a column of mixtures (T08); k is the largest number, at most ``most``."""
    parts = df.withColumn("parts\x00", split_fragments(F.col(column)))
    k = min(parts.agg(F.max(F.size("parts\x00"))).first()[0] or 0, most)
    made = {f"{column}_{i + 1}": F.get("parts\x00", F.lit(i)) for i in range(k)}
    return parts.withColumns(made | {f"{column}_n_components": F.size("parts\x00"), f"{column}_key": composition_key(F.col("parts\x00"))}).drop("parts\x00")


def molecular_graph(text: Column) -> Column:
    """(atoms array<(element, aromatic, hydrogens, charge, isotope)>, bonds array<(i, j, order)>) of a structure text; null if it can't be read.

    One fold over the text's tokens, with the open branches as a stack and the open rings as a list.
    Hydrogens of atoms outside brackets fill up the usual valence; those of atoms in lower case the lowest one,
    of which the ring takes one. ``aromatic`` says how an atom is written. Chirality and directions of bonds aren't kept.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    zero = F.expr(f"named_struct('atoms', cast(array() as {_ATOMS}), 'bonds', cast(array() as {_BONDS}), 'stack', cast(array() as array<int>), 'rings', cast(array() as {_BONDS}), 'marks', cast(array() as array<string>), 'last', -1, 'order', 0, 'ok', true)")

    def step(s: Column, t: Column) -> Column:
        first = F.substring(t, 1, 1)
        bracket, ring = first == "[", first.rlike("[0-9%]")
        opens, closes, dot = t == "(", t == ")", t == "."
        order_of = F.try_element_at(_map(ORDERS), t)
        atom = ~(ring | opens | closes | dot | order_of.isNotNull())
        symbol = F.when(bracket, F.regexp_extract(t, BRACKET, 2)).otherwise(t)
        element = F.concat(F.upper(F.substring(symbol, 1, 1)), F.substring(symbol, 2, 2))
        count = F.regexp_extract(t, BRACKET, 4)
        hydrogens = F.when(bracket, F.when(count == "", 0).when(count == "H", 1).otherwise(F.substring(count, 2, 9).try_cast("int")))
        sign = F.regexp_extract(t, BRACKET, 5)
        size = F.when(F.length(sign) == 1, 1).when(sign.rlike("[0-9]"), F.substring(sign, 2, 9).try_cast("int")).otherwise(F.length(sign))
        charge = F.when(~bracket | (sign == ""), 0).when(sign.startswith("-"), -size).otherwise(size)
        isotope = F.when(bracket, F.coalesce(F.regexp_extract(t, BRACKET, 1).try_cast("int"), F.lit(0))).otherwise(0)
        n, last, order = F.size(s["atoms"]), s["last"], s["order"]
        place = F.array_position(s["marks"], t).cast("int")
        other = F.get(s["rings"], place - 1)

        def bond(i: Column, j: Column, o: Column) -> Column:
            return F.array(F.struct(i.alias("i"), j.alias("j"), o.alias("order")))

        def without(items: Column) -> Column:
            return F.filter(items, lambda _, k: k != place - 1)

        known = F.greatest(order, F.lit(1))
        closing = F.greatest(F.when(order > 0, order).otherwise(other["order"]), F.lit(1))
        return F.struct(
            F.when(atom, F.concat(s["atoms"], F.array(F.struct(element.alias("element"), symbol.rlike("^[a-z]").alias("aromatic"), hydrogens.alias("hydrogens"), charge.alias("charge"), isotope.alias("isotope"))))).otherwise(s["atoms"]).alias("atoms"),
            F.when(atom & (last >= 0), F.concat(s["bonds"], bond(last, n, known))).when(ring & (place > 0), F.concat(s["bonds"], bond(other["i"], last, closing))).otherwise(s["bonds"]).alias("bonds"),
            F.when(opens, F.concat(s["stack"], F.array(last))).when(closes, F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"]).alias("stack"),
            F.when(ring & (place > 0), without(s["rings"])).when(ring, F.concat(s["rings"], bond(last, last, order))).otherwise(s["rings"]).alias("rings"),
            F.when(ring & (place > 0), without(s["marks"])).when(ring, F.concat(s["marks"], F.array(t))).otherwise(s["marks"]).alias("marks"),
            F.when(atom, n).when(closes, F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(-1))).when(dot, F.lit(-1)).otherwise(last).alias("last"),
            F.when(order_of.isNotNull(), order_of).when(atom | ring | dot, F.lit(0)).otherwise(order).alias("order"),
            (s["ok"] & F.when(atom, F.array_contains(F.array(*map(F.lit, WEIGHTS)), element) & (~bracket | t.rlike(f"^{BRACKET}$"))).when(ring, last >= 0).when(closes, F.size(s["stack"]) > 0).otherwise(True)).alias("ok"),
        )

    def finish(s: Column) -> Column:
        def filled(a: Column, k: Column) -> Column:
            used = F.aggregate(s["bonds"], F.lit(0), lambda n, b: n + F.when(b["i"] == k, b["order"]).otherwise(0) + F.when(b["j"] == k, b["order"]).otherwise(0))
            need = used + a["aromatic"].cast("int")
            known = F.try_element_at(_map({e: F.array(*map(F.lit, v)) for e, v in VALENCES.items()}), a["element"])
            usual = F.get(F.filter(F.when(a["aromatic"], F.slice(known, 1, 1)).otherwise(known), lambda v: v >= need), F.lit(0))
            return a.withField("hydrogens", F.coalesce(a["hydrogens"], usual - need, F.lit(0)))

        whole = s["ok"] & (F.size(s["stack"]) == 0) & (F.size(s["rings"]) == 0) & (F.size(s["atoms"]) > 0)
        return F.when(whole, F.struct(F.transform(s["atoms"], filled).alias("atoms"), s["bonds"].alias("bonds")))

    return F.when(F.array_join(tokens, "") == text, F.aggregate(tokens, zero, step, finish))


def _map(values: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in values.items() for x in pair])


_ATOMS, _BONDS = "array<struct<element:string,aromatic:boolean,hydrogens:int,charge:int,isotope:int>>", "array<struct<i:int,j:int,order:int>>"


def _facts(atoms: Column, bonds: Column) -> dict[str, Column]:
    """Graph counts, weight, epoxide rings and hydrogens on nitrogen."""
    n, e = F.size(atoms), F.size(bonds)
    labels = F.aggregate(bonds, F.sequence(F.lit(0), n - 1), lambda own, b: F.transform(own, lambda x: F.when(x == F.get(own, b["j"]), F.get(own, b["i"])).otherwise(x)))
    carbons = F.filter(bonds, lambda b: (F.get(atoms, b["i"])["element"] == "C") & (F.get(atoms, b["j"])["element"] == "C"))
    edges = F.array_distinct(F.transform(carbons, lambda b: F.struct(F.least(b["i"], b["j"]).alias("i"), F.greatest(b["i"], b["j"]).alias("j"))))

    def touches(k: Column, i: Column) -> Column:
        return F.exists(bonds, lambda b: ((b["i"] == k) & (b["j"] == i)) | ((b["i"] == i) & (b["j"] == k)))

    def bridges(edge: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda k: (F.get(atoms, k)["element"] == "O") & touches(k, edge["i"]) & touches(k, edge["j"])))

    weight = F.aggregate(atoms, F.lit(0.0), lambda w, a: w + F.try_element_at(_map(WEIGHTS), a["element"]) + a["hydrogens"] * WEIGHTS["H"])
    return {
        "n_atoms": n, "n_bonds": e, "avg_degree": e * 2.0 / n, "density": F.when(n > 1, e * 2.0 / (n * (n - 1))).otherwise(0.0), "n_rings": e - n + F.size(F.array_distinct(labels)),
        "n_aromatic": F.size(F.filter(atoms, lambda a: a["aromatic"])), "weight": weight, "n_epoxides": F.aggregate(edges, F.lit(0), lambda x, edge: x + bridges(edge)),
        "n_active_hydrogens": F.aggregate(atoms, F.lit(0), lambda x, a: x + F.when(a["element"] == "N", a["hydrogens"]).otherwise(0)),
    }


def once_each(df: DataFrame, column: str, made: Callable[[DataFrame], DataFrame], how: str = "left") -> DataFrame:
    """``df`` joined with the rows that ``made`` makes of its distinct texts in ``column`` (a table of one column, ``text\\0``, which it keeps).

    Structures come again in many rows, and reading one costs far more than a shuffle: each text is read once. Texts are dealt to all of the session's
    partitions, as few files may hold them; the join is one of shuffles, so no number of texts passes through the driver.
    """
    texts = df.select(F.col(column).alias("text\x00")).where(F.col("text\x00").isNotNull()).distinct()
    found = made(texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text\x00"))
    return df.join(found.hint("merge"), F.col(column) == F.col("text\x00"), how).drop("text\x00")


def read_each(texts: DataFrame, text: Column) -> DataFrame:
    """(text\\0, graph\\0): the perceived structure of each text, as ``text`` cleans it; null where it can't be read."""
    # An exploded array of one keeps a value from being computed again for each of its parts that is read.
    return texts.select("text\x00", F.explode(F.array(perceived(molecular_graph(text)))).alias("graph\x00"))


def with_each(df: DataFrame, column: str, name: str, *steps: Callable[[Column], Column], text: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """``df`` with ``name``: the last of ``steps``, the first of which takes the perceived structure in ``column`` and each other one the value before, computed once for each text; null for null."""

    def made(texts: DataFrame) -> DataFrame:
        out = read_each(texts, text(F.col("text\x00")))
        for step in steps:
            out = out.select("text\x00", F.explode(F.array(step(F.col("graph\x00")))).alias("graph\x00"))
        return out.withColumnRenamed("graph\x00", name)

    return once_each(df, column, made)


def graph_features(df: DataFrame, column: str, keep_all: bool = True) -> DataFrame:
    """``df`` with the facts of the structure in ``column`` (F03, F08): null where it can't be read, or without those rows.

    Atoms of aromatic rings count as such however they are written (see ``perception.perceived``).
    """

    def facts(g: Column) -> Column:
        return F.when(g.isNotNull(), F.struct(*(c.alias(name) for name, c in _facts(g["atoms"], g["bonds"]).items())))

    out = with_each(df, column, "facts\x00", facts).select(*df.columns, "facts\x00.*")
    return out if keep_all else out.where("n_atoms is not null")


def _with_hydrogens(g: Column) -> Column:
    """A perceived structure with its hydrogens as atoms of their own, after the others, each on a single bond."""
    owners = F.flatten(F.transform(g["atoms"], lambda a, k: F.array_repeat(k, a["hydrogens"])))
    hydrogen = F.struct(F.lit("H").alias("element"), F.lit(False).alias("aromatic"), F.lit(0).alias("hydrogens"), F.lit(0).alias("charge"), F.lit(0).alias("isotope"))

    def both(owners: Column) -> Column:
        n = F.size(g["atoms"])
        bonds = F.transform(owners, lambda k, nth: F.struct(k.alias("i"), (n + nth).alias("j"), F.lit(1).alias("order"), F.lit(False).alias("aromatic"), F.lit(False).alias("in_ring"), F.lit(False).alias("conjugated")))
        return F.struct(F.concat(F.transform(g["atoms"], lambda a: a.withField("hydrogens", F.lit(0))), F.transform(owners, lambda _: hydrogen)).alias("atoms"), F.concat(g["bonds"], bonds).alias("bonds"))

    return let(owners, both)


def _perceived_rows(texts: DataFrame, hydrogens: bool) -> DataFrame:
    graph = read_each(texts, F.col("text\x00")).withColumnRenamed("graph\x00", "g").where("g is not null")
    return graph.select("text\x00", _with_hydrogens(F.col("g")).alias("g")) if hydrogens else graph


def atom_rows(df: DataFrame, key: str, column: str, hydrogens: bool = False) -> DataFrame:
    """(key, atom, element, features): an atom a row, its features as an array.

    A place for each of ATOM_SYMBOLS, 1 at the atom's own (the last one for others); then the number of the
    element over 100, neighbours over 10, aromatic or not, hydrogens over 5, valence over 8. With ``hydrogens`` these are
    rows too, after the others, and neighbours; structures that can't be read have no rows.
    """
    return once_each(df.select(key, F.col(column).alias("structure\x00")), "structure\x00", lambda texts: _atoms_of(texts, hydrogens), "inner").select(key, "atom", "element", "features")


def _atoms_of(texts: DataFrame, hydrogens: bool) -> DataFrame:
    graph = _perceived_rows(texts, hydrogens).select("text\x00", "g.bonds", F.posexplode("g.atoms").alias("atom", "a"))
    own = F.filter("bonds", lambda b: (b["i"] == F.col("atom")) | (b["j"] == F.col("atom")))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ATOM_SYMBOLS)), F.col("a.element")), F.lit(0)), F.lit(len(ATOM_SYMBOLS)))
    symbols = F.transform(F.sequence(F.lit(1), F.lit(len(ATOM_SYMBOLS))), lambda k: (k == place).cast("double"))
    # An aromatic atom that gives one electron to its ring has a double bond there, written or not.
    degree = F.size(own) + F.col("a.hydrogens")
    gives_one = ((F.col("a.element") == "C") & (F.col("a.charge") == 0)) | (F.col("a.element").isin("N", "P") & (F.col("a.charge") >= 0) & (degree == 2 + F.col("a.charge")))
    unwritten = F.col("a.aromatic") & gives_one & ~F.exists(own, lambda b: b["order"] > 1)
    valence = F.aggregate(own, F.col("a.hydrogens") + unwritten.cast("int"), lambda n, b: n + b["order"])
    numbers = F.array(F.try_element_at(_map(NUMBERS), F.col("a.element")) / 100.0, F.size(own) / 10.0, F.col("a.aromatic").cast("double"), F.col("a.hydrogens") / 5.0, valence / 8.0)
    return graph.select("text\x00", "atom", F.col("a.element").alias("element"), F.concat(symbols, numbers).alias("features"))


def bond_rows(df: DataFrame, key: str, column: str, hydrogens: bool = False) -> DataFrame:
    """(key, i, j, features): a bond a row; single, double, triple, aromatic, in a ring, conjugated or not, as 0 or 1."""
    return once_each(df.select(key, F.col(column).alias("structure\x00")), "structure\x00", lambda texts: _bonds_of(texts, hydrogens), "inner").select(key, "i", "j", "features")


def _bonds_of(texts: DataFrame, hydrogens: bool) -> DataFrame:
    graph = _perceived_rows(texts, hydrogens).select("text\x00", F.explode("g.bonds").alias("b"))
    plain = ~F.col("b.aromatic")
    kinds = [(F.col("b.order") == 1) & plain, (F.col("b.order") == 2) & plain, (F.col("b.order") == 3) & plain, F.col("b.aromatic"), F.col("b.in_ring"), F.col("b.conjugated")]
    return graph.select("text\x00", F.col("b.i").alias("i"), F.col("b.j").alias("j"), F.array(*[k.cast("double") for k in kinds]).alias("features"))


def lifetimes(values: Column) -> Column:
    """Statistics of a diagram's lifetimes (F11): an empty diagram counts as one lifetime of 0."""
    v = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(0.0)))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    n = F.size(v).cast("double")
    mean = total / n
    spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    entropy = F.when(total > 0, -F.aggregate(v, F.lit(0.0), lambda a, x: a + x / total * F.log(x / total + 1e-10))).otherwise(0.0)
    return F.struct(n.alias("count"), F.array_max(v).alias("max"), mean.alias("mean"), total.alias("sum"), spread.alias("std"), entropy.alias("entropy"))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Mean of token vectors where the mask is 1."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    width = F.size(F.get(tokens, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.aggregate(kept, F.lit(0.0), lambda a, t: a + F.get(t["v"], j)) / n)


def sample_energies(fragments: DataFrame, key: str) -> DataFrame:
    """Fragment energies and forces as one row a sample (F07): sum of energies; mean, largest and spread of force norms."""
    return fragments.groupBy(key).agg(F.sum("energy").alias("energy"), F.avg("force_norm").alias("force_mean"), F.max("force_norm").alias("force_max"), F.stddev_pop("force_norm").alias("force_std"))


def first_class(text: Column, classes: dict[str, Column], default: str = "Other") -> Column:
    """The first class whose condition holds, in order."""
    out = F
    for name, condition in classes.items():
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.when(text.isNotNull(), F.lit(default)))


def concat_bits(first: Column, second: Column) -> Column:
    """Fingerprints of two components as one; null if either is."""
    return F.concat(first, second)


def used_bits(df: DataFrame, column: str) -> list[int]:
    """Places of a bit array that any row sets."""
    rows = df.select(F.posexplode(column).alias("place", "bit")).where("bit > 0").select("place").distinct().orderBy("place").collect()
    return [r["place"] for r in rows]
