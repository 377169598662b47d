"""Methods that nothing calls, minus those that frameworks, contracts or reflection call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that exempt a method.
ENTRY_ANNOTATIONS = """Test ParameterizedTest BeforeEach AfterEach BeforeAll AfterAll RequestMapping GetMapping PostMapping PutMapping
DeleteMapping PatchMapping MessageMapping KafkaListener RabbitListener JmsListener SqsListener StreamListener PostConstruct PreDestroy
EventListener TransactionalEventListener Scheduled PrePersist PostPersist PreUpdate PostUpdate PreRemove PostRemove PostLoad""".split()
BROAD_ANNOTATIONS = """Override Component Service Repository Controller RestController Configuration Bean Aspect Query Modifying Inject
Provides Singleton Named Qualifier ApplicationScoped RequestScoped SessionScoped Dependent JsonCreator JsonProperty JsonDeserialize
JsonSerialize""".split()
CONTRACT_METHODS = "toString hashCode equals compareTo".split()
REFLECTION_HOOKS = "valueOf fromString builder".split()
ROLE_SUFFIXES = "Controller RestController Service Repository Listener Handler Mapper Converter Factory Configuration Config Entity".split()
FRAMEWORK_FOLDERS = "controller controllers service services repository repositories listener listeners handler handlers mapper mappers entity entities config".split()

REASON = "no_incoming_calls_after_exemptions"


def _annotations() -> Column:
    """Names of annotations among the modifiers, without the sign and arguments."""
    return F.transform(F.filter(F.coalesce("modifiers", F.array().cast("array<string>")), lambda m: m.startswith("@")), lambda m: F.regexp_extract(m, r"^@([A-Za-z0-9_$.]*\.)?([A-Za-z0-9_$]+)", 2))


def _has_modifier(name: str) -> Column:
    return F.coalesce(F.array_contains("modifiers", name), F.lit(False))


def exemption(strict: bool) -> Column:
    """Why a candidate isn't dead, or null. The first rule that holds counts."""
    name, sig = F.col("name"), F.lower("signature")
    wanted = ENTRY_ANNOTATIONS if strict else ENTRY_ANNOTATIONS + BROAD_ANNOTATIONS
    hit = F.filter(_annotations(), lambda a: a.isin(wanted))
    rule = (
        F.when(F.col("is_test"), "test_method")
        .when((name == "main") & (sig.contains("string[]") | sig.contains("string...") | (sig == "main(string)")), "main_method")
        .when(F.size(hit) > 0, F.concat(F.lit("annotation:"), F.element_at(hit, 1)))
    )
    if strict:
        return rule
    simple = F.substring_index("class_fqcn", ".", -1)
    public_accessor = _has_modifier("public") & name.rlike(r"^(get|set|is).")
    return (
        rule.when(F.col("is_constructor"), "constructor")
        .when(simple.rlike("(" + "|".join(ROLE_SUFFIXES) + ")$"), "class_role")
        .when(F.lower("file_path").rlike("/(" + "|".join(FRAMEWORK_FOLDERS) + ")/"), "framework_path")
        .when(name.isin(CONTRACT_METHODS), "contract_method")
        .when(public_accessor, "bean_accessor")
        .when(name.isin(REFLECTION_HOOKS), "reflection_hook")
    )


def confidence(strict: bool) -> Column:
    return F.lit("high") if strict else F.when(_has_modifier("private"), "high").when(_has_modifier("public"), "low").otherwise("medium")


def classified(methods: DataFrame, calls: DataFrame, overrides: DataFrame, strict: bool = False) -> DataFrame:
    """Methods without incoming calls, with ``exempt`` (null for the dead) and ``confidence``.

    methods: method_id, name, signature, modifiers, class_fqcn, is_constructor, is_test, file_path.
    Overriding methods and those that others override are exempt in either mode.
    """
    candidates = methods.join(calls.select(F.col("dst_id").alias("method_id")), "method_id", "left_anti")
    up = overrides.select(F.col("src_id").alias("method_id")).distinct().withColumn("overriding", F.lit(True))
    down = overrides.select(F.col("dst_id").alias("method_id")).distinct().withColumn("overridden", F.lit(True))
    joined = candidates.join(up, "method_id", "left").join(down, "method_id", "left")
    by_contract = F.when(F.col("overriding"), "method_override").when(F.col("overridden"), "interface_or_base_contract")
    return joined.withColumn("exempt", F.coalesce(exemption(strict), by_contract)).withColumn("confidence", confidence(strict)).drop("overriding", "overridden")


def dead_methods(methods: DataFrame, calls: DataFrame, overrides: DataFrame, limit: int = 200, strict: bool = False) -> DataFrame:
    """The dead, by id, ``limit`` at most. The limit is applied after all exemptions."""
    dead = classified(methods, calls, overrides, strict).where("exempt is null")
    return dead.orderBy("method_id").limit(limit).select("method_id", "name", "signature", "class_fqcn", "file_path", "confidence", F.lit(REASON).alias("reason"))


def exemption_stats(found: DataFrame) -> DataFrame:
    """reason, n: exempted candidates by rule, annotations together."""
    return found.where("exempt is not null").groupBy(F.substring_index("exempt", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
