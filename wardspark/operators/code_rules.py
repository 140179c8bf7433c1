"""Rules over calls and assignments in Python sources."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.functions.code_facts import code_facts_udf
from wardspark.functions.regex import any_contains
from wardspark.operators.hits import hit, no_hits

# Words and names of the rules.
PICKLE_NAMES = ["pickle.loads", "pickle.load", "_pickle.loads", "_pickle.load"]
PICKLE_RESOLVED = ["pickle.loads", "pickle.load"]
SHELL_NAMES = ["os.system", "os.popen"]
SUBPROCESS_NAMES = ["subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output"]
RANDOM_NAMES = ["random.random", "random.randint", "random.choice", "random.randrange"]
EVAL_WORDS = ["response", "llm", "completion", "message.content", "chat", "generated"]
QUERY_NAMES = ["execute", "raw_sql", "execute_query"]
QUERY_WORDS = ["llm", "response", "output", "prompt", "user_input", "generated"]
TOOL_NAMES = ["register_tool", "add_tool", "tool_executor"]
TOOL_FLAGS = ["auto_approve", "dangerous_allow_all", "unrestricted", "skip_confirmation"]
SECRET_NAMES = ["token", "secret", "session_id", "auth_key", "salt", "nonce", "otp"]

# Identifiers without which no rule can fire.
CODE_GROUP = ["load", "eval", "exec", "system", "popen", "subprocess", "debug", "tool", "raw_sql", "random"]


def is_python(path: Column) -> Column:
    return F.endswith(path, F.lit(".py")) | F.endswith(path, F.lit(".pyw"))


def with_code_facts(artifacts: DataFrame, condition: Column | None = None) -> DataFrame:
    """Adds ``facts`` to Python artifacts; null for others and for sources that do not parse.

    ``condition`` narrows the sources that are parsed at all.
    """
    wanted = is_python(F.col("path")) if condition is None else is_python(F.col("path")) & condition
    return artifacts.withColumn("facts", code_facts_udf()(F.when(wanted, F.col("content"))))


def resolve_imports(artifacts: DataFrame) -> DataFrame:
    """The call table of Python artifacts: one row per call. ``resolved_name`` is the full name behind a bare name: that of the latest import of
    the name above the call, else the name itself."""
    rows = with_code_facts(artifacts).where("facts is not null").select("path", "target", F.explode("facts.calls").alias("call"))
    return rows.select("path", "target", "call.*").drop("torch_seen")


def import_table(artifacts: DataFrame) -> DataFrame:
    return (
        with_code_facts(artifacts).where("facts is not null")
        .select("path", "target", F.explode("facts.imports").alias("i")).select("path", "target", "i.*")
    )


def assign_table(artifacts: DataFrame) -> DataFrame:
    return (
        with_code_facts(artifacts).where("facts is not null")
        .select("path", "target", F.explode("facts.assigns").alias("a")).select("path", "target", "a.*")
    )


def _flag(call: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(call["kwargs"], F.lit(name)) == "True", F.lit(False))


def _branch(call: Column) -> Column:
    """The rule of the first branch that takes the call; a branch may take a call and find nothing."""
    func, resolved = call["func"], call["resolved_name"]
    none = F.lit(None).cast("string")
    rule_if = lambda condition, rule: F.when(condition, F.lit(rule)).otherwise(none)
    loader = F.coalesce(F.try_element_at(call["kwargs"], F.lit("Loader")), F.lit(""))
    return (
        F.when(func.isin(PICKLE_NAMES) | resolved.isin(PICKLE_RESOLVED), F.lit("AST-DESER-001"))
        .when((func == "torch.load") | ((func == "load") & (F.contains(resolved, F.lit("torch.load")) | call["torch_seen"])),
              rule_if(~_flag(call, "weights_only"), "AST-DESER-002"))
        .when(func.isin("np.load", "numpy.load") | F.contains(resolved, F.lit("numpy.load")),
              rule_if(_flag(call, "allow_pickle"), "AST-DESER-003"))
        .when((func == "joblib.load") | F.contains(resolved, F.lit("joblib.load")), F.lit("AST-DESER-003"))
        .when(func == "yaml.unsafe_load", F.lit("AST-DESER-004"))
        .when(func == "yaml.load", rule_if(~any_contains(loader, ["SafeLoader", "safe_load"]), "AST-DESER-004"))
        .when(func.isin("eval", "exec"),
              F.when(any_contains(F.lower(call["first_arg_src"]), EVAL_WORDS), F.lit("AST-LLMOUT-001")).otherwise(F.lit("AST-EXEC-001")))
        .when(func.isin(SHELL_NAMES), F.lit("AST-EXEC-002"))
        .when(func.isin(SUBPROCESS_NAMES), rule_if(_flag(call, "shell"), "AST-EXEC-002"))
        .when(func.isin(RANDOM_NAMES), none)
        .when((func == "run") | F.endswith(func, F.lit(".run")), rule_if(_flag(call, "debug"), "AST-DEBUG-001"))
        .otherwise(none)
    )


def code_hits(facts: Column) -> Column:
    """All hits of an artifact's facts."""
    def of_call(call: Column) -> Column:
        low = F.lower(call["func"])
        place = lambda rule, order, nth=0: hit("ast", rule, call["line"], call["col"], [call["seq"], order, nth])
        chain = F.filter(F.array(place(_branch(call), 0)), lambda h: h["rule_id"].isNotNull())
        flags = F.filter(F.map_entries(call["kwargs"]), lambda e: e["key"].isin(TOOL_FLAGS) & (e["value"] == "True"))
        agent = F.when(any_contains(low, TOOL_NAMES), F.transform(flags, lambda e, i: place("AST-AGENT-001", 1, i))).otherwise(no_hits())
        queried = (
            any_contains(low, QUERY_NAMES) & (call["first_arg_kind"] == "JoinedStr")
            & any_contains(F.lower(call["first_arg_src"]), QUERY_WORDS)
        )
        return F.concat(chain, agent, F.when(queried, F.array(place("AST-LLMOUT-002", 2))).otherwise(no_hits()))

    weak = F.filter(
        facts["assigns"],
        lambda a: any_contains(F.lower(a["target"]), SECRET_NAMES) & F.contains(a["value_src"], F.lit("random.")),
    )
    found = F.concat(
        F.flatten(F.transform(facts["calls"], of_call)),
        F.transform(weak, lambda a, i: hit("ast", "AST-RAND-001", a["line"], a["col"], [a["seq"], 3, i])),
    )
    return F.when(facts.isNotNull(), found).otherwise(no_hits())
