"""From call sites and type names to edges: tiers of equi-joins, the first that finds anything wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import scratch, stage

# Methods too common to resolve.
NOISE = """print println printf hashCode equals toString getClass notify notifyAll wait clone finalize compareTo isEmpty size length stream
parallelStream forEach map filter collect orElse orElseGet add append remove contains log debug info warn error""".split()
#: More targets than this are no evidence.
MOST_TARGETS = 12
#: Sources, or methods, in a list. A list of methods is repeated for each source of a list; as it is short, and its
#: packed numbers end with a byte (a multiple of 8), a column format stores the edges in little more than their factors.
LISTED = 256
#: Edges that a file of pairs of lists makes, about, so that tasks get even shares: bytes tell nothing of their number.
EDGES_IN_FILE = 25_000_000
#: Confidence and reason of an edge by how it was found.
THIS, TYPED, OWN, UNIQUE, AMBIGUOUS = range(5)
REASONS = {
    THIS: (1.0, "receiver_this_exact"), TYPED: (0.8, "receiver_method_match"), OWN: (1.0, "intra_class_exact"),
    UNIQUE: (1.0, "exact_name_arity_unique"), AMBIGUOUS: (0.5, "fuzzy_name_arity_ambiguous"),
}


def type_candidates(name: Column, imports: Column, package: Column) -> Column:
    """Qualified names that a type name can stand for: itself if dotted, imported, or of the same package."""
    plain = F.regexp_replace(name, r"(\[\])+$", "")
    simple = F.substring_index(plain, ".", -1)
    imports = F.coalesce(imports, F.array().cast("array<string>"))
    named = F.filter(imports, lambda i: F.substring_index(i, ".", -1) == simple)
    wild = F.transform(F.filter(imports, lambda i: i.endswith(".*")), lambda i: F.concat(F.regexp_replace(i, r"\*$", ""), simple))
    own = F.array(F.when(package == "", simple).otherwise(F.concat(package, F.lit("."), simple)))
    dotted = F.when(plain.contains("."), F.array(plain)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(dotted, named, wild, own))


def resolve_calls(sites: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """src_id, dst_id, confidence, reason.

    sites: call_id, source_id, name, receiver, arg_count, class_id, class_fqcn, package, imports,
    local_types, field_types; a call_id belongs to one source. methods: id, name, param_count, class_id,
    class_fqcn. classes: fqcn, name. A call finds its tier by numbers of groups of methods; groups become
    methods in the last join alone, so no edge is shuffled, however many there are. Lists of sources
    meet lists of methods first (see LISTED); those pairs are staged, and opened where they are read.
    """
    with scratch():
        m = stage(methods.select(F.col("id").alias("dst_id"), F.col("name").alias("called"), F.col("param_count").alias("arg_count"), "class_id", F.col("class_fqcn").alias("fqcn")), "callable")
        # looked up by whole keys, so each is one row for a call at most; staged, so that small ones are broadcast
        by_fqcn = stage(m.select("fqcn", "called", "arg_count").distinct().withColumn("typed_group", F.monotonically_increasing_id() * 2), "by-fqcn")
        by_class = stage(m.select("class_id", "called", "arg_count").distinct().withColumn("own_group", F.monotonically_increasing_id() * 2 + 1), "by-class")
        by_simple = stage(_by_simple_name(by_fqcn, classes), "by-simple")
        # a package's targets are among all, so what the third tier drops the fourth drops too
        parts = F.split("fqcn", r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        by_package = stage(_few(m.where(F.size(parts) > 1).select("dst_id", "called", "arg_count", F.explode(prefixes).alias("package")), ["package", "called", "arg_count"], "near"), "by-package")
        by_name = stage(_few(m, ["called", "arg_count"], "far"), "by-name")

        receiver = F.col("receiver")
        kind = F.when(receiver != "this", F.coalesce(F.col("local_types")[receiver], F.col("field_types")[receiver], receiver))
        site = sites.where(~F.col("name").isin(NOISE)).withColumnRenamed("name", "called").withColumn("type", kind)
        simple = F.substring_index(F.regexp_replace("type", r"(\[\])+$", ""), ".", -1)
        site = site.withColumn("simple", simple).withColumn("fqcn", F.when(receiver == "this", F.col("class_fqcn")))
        looked = site.join(by_fqcn, ["fqcn", "called", "arg_count"], "left").join(by_simple, ["simple", "called", "arg_count"], "left").join(by_class, ["class_id", "called", "arg_count"], "left")
        looked = looked.join(by_package, ["package", "called", "arg_count"], "left").join(by_name, ["called", "arg_count"], "left")

        guesses = type_candidates(F.col("type"), F.col("imports"), F.col("package"))
        guessed = F.transform(F.filter("guessable", lambda g: F.array_contains(guesses, g.fqcn)), lambda g: g.typed_group)
        no_groups, no_targets = F.array().cast("array<bigint>"), F.array().cast(by_name.schema["far"].dataType)
        typed = F.when(F.col("simple").isNotNull(), F.coalesce(F.concat("anywhere", guessed), no_groups)).otherwise(no_groups)
        told = looked.select("call_id", "source_id", "typed_group", typed.alias("typed"), "own_group", "near", "near_targets", "far", "far_targets")

        def hit(tier: int, reason: Column | int, groups: Column = no_groups, targets: Column = no_targets) -> Column:
            return F.struct(F.lit(tier).alias("tier"), (F.lit(reason) if isinstance(reason, int) else reason).alias("how"), groups.alias("groups"), targets.alias("targets"))

        scored = lambda targets: F.when(F.col(targets) == 1, UNIQUE).otherwise(AMBIGUOUS)
        first = (
            F.when(F.col("typed_group").isNotNull(), hit(1, THIS, F.array("typed_group"))).when(F.size("typed") > 0, hit(1, TYPED, F.col("typed")))
            .when(F.col("own_group").isNotNull(), hit(2, OWN, F.array("own_group")))
            .when(F.col("near").isNotNull(), hit(3, scored("near_targets"), targets=F.col("near"))).when(F.col("far").isNotNull(), hit(4, scored("far_targets"), targets=F.col("far")))
        )
        found = told.select("call_id", "source_id", first.alias("hit")).where("hit is not null").select("call_id", "source_id", "hit.*")
        # dealt by source, which serves the least tier of a call and the distinct rows of a source
        least = F.min("tier").over(Window.partitionBy("source_id", "call_id"))
        found = found.repartition("source_id").withColumn("least", least).where("tier = least")
        none, of = F.lit(None), m.schema["dst_id"].dataType
        ends = F.concat(
            F.transform("groups", lambda g: F.struct(g.alias("group"), none.cast(of).alias("dst_id"))), F.transform("targets", lambda t: F.struct(none.cast("bigint").alias("group"), t.alias("dst_id")))
        )
        chosen = stage(found.select("source_id", "how", F.explode(ends).alias("end")).select("source_id", "how", "end.*").distinct(), "chosen-groups", outer=True)
        members = m.join(by_fqcn, ["fqcn", "called", "arg_count"]).select(F.col("typed_group").alias("group"), "dst_id")
        members = members.unionByName(m.join(by_class, ["class_id", "called", "arg_count"]).select(F.col("own_group").alias("group"), "dst_id"))
        members = stage(_listed(members.distinct(), [], "dst_id"), "group-members")
        calls = chosen.where("group is not null").select("group", "how", "source_id")
        known = calls.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(members.groupBy("group").agg(F.sum(F.size("dst_id")).alias("of"), F.count(F.lit(1)).alias("lists")), "group")
        pairs_of, edges_of = known.agg(F.sum(F.ceil(F.col("n") / LISTED) * F.col("lists")), F.sum(F.col("n") * F.col("of"))).first()
        pairs = _listed(calls, ["how"], "source_id").join(members, "group").drop("group")
        pairs = stage(pairs, "edge-lists", outer=True, most=max(1, EDGES_IN_FILE * pairs_of // edges_of) if edges_of else 0)

    # numbers in place of explode: a list is opened where it is read, and what is made stays there
    nth, of = (chosen.sparkSession.range(LISTED).withColumnRenamed("id", name) for name in ("nth", "of"))
    opened = pairs.join(nth, F.col("nth") < F.size("source_id")).select(F.get("source_id", "nth").alias("source_id"), "dst_id", "how")
    grouped = opened.join(of, F.col("of") < F.size("dst_id")).select("source_id", F.get("dst_id", "of").alias("dst_id"), "how")
    edges = grouped.unionByName(chosen.where("group is null").select("source_id", "dst_id", "how"))
    how = lambda i: reduce(lambda w, k: w.when(F.col("how") == k, REASONS[k][i]), sorted(REASONS), F)
    return edges.select(F.col("source_id").alias("src_id"), "dst_id", how(0).alias("confidence"), how(1).alias("reason"))


def _listed(rows: DataFrame, by: list[str], what: str) -> DataFrame:
    """group, ``by`` and ``what`` as lists of LISTED values at most, nulls among them."""
    nth = F.row_number().over(Window.partitionBy("group").orderBy(*by, what))
    lists = rows.withColumn("list", F.floor((nth - 1) / LISTED)).groupBy("group", *by, "list").agg(F.collect_list(F.struct(what)).alias("all"))
    return lists.select("group", *by, F.transform("all", lambda x: x[what]).alias(what))


def _by_simple_name(by_fqcn: DataFrame, classes: DataFrame) -> DataFrame:
    """By simple name, method name and arity: groups of the classes of this name (anywhere), and of others whose
    qualified name ends so (guessable: all candidates of a type end in its simple name)."""
    key = ["simple", "called", "arg_count"]
    named = by_fqcn.join(classes.select("fqcn", F.col("name").alias("simple")), "fqcn").select(*key, "fqcn", "typed_group", F.lit(True).alias("named"))
    ending = by_fqcn.select(F.substring_index("fqcn", ".", -1).alias("simple"), "called", "arg_count", "fqcn", "typed_group", F.lit(False).alias("named"))
    each = named.unionByName(ending).groupBy(*key, "fqcn", "typed_group").agg(F.max("named").alias("named"))
    anywhere, guessable = F.when(F.col("named"), F.col("typed_group")), F.when(~F.col("named"), F.struct("fqcn", "typed_group"))
    return each.groupBy(*key).agg(F.collect_list(anywhere).alias("anywhere"), F.collect_list(guessable).alias("guessable"))


def _few(methods: DataFrame, on: list[str], name: str) -> DataFrame:
    """The targets of groups that have few; the others go before the join, so a hot name never meets all its methods."""
    few = methods.groupBy(*on).agg(F.count(F.lit(1)).alias(f"{name}_targets")).where(F.col(f"{name}_targets") <= MOST_TARGETS)
    return methods.join(few, on).groupBy(*on, f"{name}_targets").agg(F.collect_set("dst_id").alias(name))


def resolve_inheritance(types: DataFrame, classes: DataFrame) -> DataFrame:
    """implements edges. types: class_id, relation (extends or implements), type, imports, package; classes: id, fqcn, name."""
    guessed = types.select("class_id", "relation", F.explode(type_candidates(F.col("type"), F.col("imports"), F.col("package"))).alias("fqcn"))
    named = types.select("class_id", "relation", F.substring_index("type", ".", -1).alias("name")).join(classes.select("name", "fqcn"), "name").select("class_id", "relation", "fqcn")
    ends = guessed.unionByName(named).distinct().join(classes.select(F.col("id").alias("dst_id"), "fqcn"), "fqcn").where("dst_id <> class_id")
    scored = ends.select(F.col("class_id").alias("src_id"), "dst_id", F.when(F.col("relation") == "extends", 0.8).otherwise(1.0).alias("confidence"))
    return scored.groupBy("src_id", "dst_id").agg(F.max("confidence").alias("confidence"))


def resolve_references(sites: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """references_type edges: a method and the classes that its local variables, and its class's fields, are declared with.

    sites: source_id, local_types, field_types, imports, package; classes: id, fqcn. Only qualified
    candidates count (own package, imports, dotted names), so confidence is 1.
    """
    used = F.array_distinct(F.concat(F.coalesce(F.map_values("local_types"), F.array().cast("array<string>")), F.coalesce(F.map_values("field_types"), F.array().cast("array<string>"))))
    named = sites.select("source_id", "imports", "package", F.explode(used).alias("type"))
    guessed = named.select(F.col("source_id").alias("src_id"), F.explode(type_candidates(F.col("type"), F.col("imports"), F.col("package"))).alias("fqcn")).distinct()
    ends = guessed.join(classes.select("fqcn", F.col("id").alias("dst_id")), "fqcn").join(methods.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    return ends.select("src_id", "dst_id", F.lit(1.0).alias("confidence")).distinct()


def resolve_overrides(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """overrides edges: methods of equal signature in classes that an implements edge joins."""
    own = methods.where("not is_constructor").select(F.col("id").alias("src_id"), F.col("class_id").alias("sub"), "signature")
    base = methods.where("not is_constructor").select(F.col("id").alias("dst_id"), F.col("class_id").alias("super"), "signature")
    pairs = implements.select(F.col("src_id").alias("sub"), F.col("dst_id").alias("super"))
    return pairs.join(own, "sub").join(base, ["super", "signature"]).select("src_id", "dst_id", F.lit(1.0).alias("confidence")).distinct()


def cross_module(methods: DataFrame, classes: DataFrame, project_ids: list[str] | None = None) -> DataFrame:
    """src_id, dst_id, confidence, reason of references between projects.

    A method whose signature or return type names a class of another project is linked with that
    class's methods: 0.7 for the same name and arity, else 0.4 unless constructor or private.
    methods: id, name, signature, return_type, modifiers, is_constructor, class_id, project_id;
    classes: id, name, project_id. ``project_ids`` limits the sources and the names considered.
    """
    source = methods if project_ids is None else methods.where(F.col("project_id").isin(project_ids))
    names = classes if project_ids is None else classes.where(F.col("project_id").isin(project_ids))
    names = names.where(F.length("name") > 4).select("name").distinct()
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "signature", "return_type"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    from tessera.functions.text import parameter_count

    tokens = source.select(F.col("id").alias("src_id"), F.col("project_id").alias("src_project"), F.col("name").alias("src_name"), parameter_count(F.col("signature")).alias("src_arity"), F.explode(words).alias("name"))
    named = tokens.join(names, "name", "left_semi")
    foreign = classes.select("name", F.col("id").alias("class_id"), F.col("project_id").alias("dst_project"))
    target = methods.select("class_id", F.col("id").alias("dst_id"), F.col("name").alias("dst_name"), parameter_count(F.col("signature")).alias("dst_arity"), "is_constructor", F.coalesce(F.array_contains("modifiers", "private"), F.lit(False)).alias("private"))
    pairs = named.join(foreign, "name").where("src_project <> dst_project").join(target, "class_id")
    same = (F.col("src_name") == F.col("dst_name")) & (F.col("src_arity") == F.col("dst_arity"))
    scored = pairs.withColumn("confidence", F.when(same, 0.7).when(~F.col("is_constructor") & ~F.col("private"), 0.4)).where("confidence is not null")
    best = scored.groupBy("src_id", "dst_id").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("reason", F.when(F.col("confidence") > 0.5, "cross_module_name_match").otherwise("cross_module_type_ref"))
