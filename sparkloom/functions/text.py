"""String, path and label functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a text; a final line break ends the last line rather than starting another."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def directory(path: Column) -> Column:
    path = slashes(path)
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def prefixes(path: Column) -> Column:
    """All directories above a path, the root (``.``) first."""
    parts = F.slice(F.split(slashes(path), "/"), F.lit(1), F.size(F.split(slashes(path), "/")) - 1)
    above = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(above, F.array().cast("array<string>")))


def like(column: Column, word: str, head: str = "%", tail: str = "%", compat: bool = False) -> Column:
    """Case-insensitive LIKE; ``compat`` leaves ``%`` and ``_`` of the word as wildcards."""
    word = word if compat else word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(head + word + tail)


def contains_any(column: Column, words) -> Column:
    return reduce(Column.__or__, [column.contains(w) for w in words])


def split_words(text: str) -> list[str]:
    return text.replace(",", " ").split()


def tokens(text: Column) -> Column:
    """Distinct runs of small letters and digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def cut_chars(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def sentence_head(text: Column, separators=("。", "；", ";", ".", "\n"), longest: int = 28) -> Column:
    """Up to the first separator, in list order, that stands past the start; long heads are cut."""
    text = F.trim(text)
    head = F.coalesce(*[F.when(F.instr(text, s) > 1, F.substring_index(text, s, 1)) for s in separators], text)
    return cut_chars(F.trim(head), longest)


def fallback(value: Column, other: Column) -> Column:
    return F.coalesce(F.when(value != "", value), other)


def parsed_time(raw: Column, now: Column | None = None) -> Column:
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in forms], now if now is not None else F.current_timestamp())


def ascii_keywords(text: Column, most: int = 12) -> Column:
    """ASCII tokens of 3 to 40 characters, scheme names dropped, each once whatever its case."""
    found = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_./-]+"), 0), lambda t: F.length(t).between(3, 40) & ~F.lower(t).isin("http", "https"))
    first = F.filter(found, lambda t, i: F.array_position(F.transform(found, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)


def han_keywords(text: Column, most: int = 12) -> Column:
    """Runs of two or more Han characters, cut to four, each once."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}]{2,})"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda t: F.substring(t, 1, 4))), 1, most)


def keywords(text: Column, symbols: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.concat(symbols, ascii_keywords(text), han_keywords(text))), 1, most)


# The words that decide intents, alerts, side effects and stages.
INTENTS = ("DEBUG", "DEVELOP", "REFACTOR", "DESIGN", "RESEARCH", "PERFORMANCE", "REFLECT")
INTENT_WORDS = (
    ("DEBUG", ("debug", "fix", "修复", "报错")),
    ("REFACTOR", ("refactor", "重构")),
    ("RESEARCH", ("analy", "分析", "调研", "research")),
    ("DESIGN", ("design", "设计", "架构")),
)
ALERT_WORDS = (
    ("modification", ("修改", "update", "change")),
    ("migration", ("migrate", "迁移", "升级")),
    ("new_feature", ("开发", "新增", "添加", "implement", "create", "feature", "module")),
)
EFFECTS = (
    ("filesystem", 2, ("file", "path", "read", "write", "mkdir", "open", "close", "stat"), (), ("filepath", "rename", "remove", "copy")),
    ("database", 2, ("db", "sql", "sqlite", "insert", "update", "delete", "commit", "transaction"), ("query", "exec", "row", "rows"), ()),
    ("network", 3, ("http", "https", "grpc", "tcp", "udp", "socket", "request", "response", "listen", "dial"), (), ("websocket", "endpoint", "url", "api")),
    ("process", 2, ("exec", "command", "spawn", "process", "fork", "subprocess"), ("run", "cmd"), ()),
    ("state", 2, ("state", "cache", "memory", "session", "lock", "mutex", "atomic"), ("context",), ()),
)
STAGES = (
    ("init", ("init", "setup", "new", "bootstrap", "load")),
    ("validate", ("validate", "check", "verify", "guard")),
    ("execute", ("run", "process", "handle", "execute", "build", "index")),
    ("query", ("query", "search", "map", "trace", "analyze")),
    ("persist", ("save", "write", "insert", "commit", "persist")),
)
CALLABLE, TYPE_LIKE = ("function", "method", "func", "procedure", "lambda"), ("class", "struct", "interface", "enum", "type")
GUARDRAILS = {
    "DESIGN": ("NO_CODE_EDIT", "MD_ONLY"),
    "RESEARCH": ("READ_ONLY",),
    "DEBUG": ("VERIFY_FIRST", "NO_BLIND_REWRITE"),
    "PERFORMANCE": ("PROFILE_FIRST", "MEASURE_AFTER"),
    "REFACTOR": ("INCREMENTAL", "VERIFY_EACH_STEP"),
    "REFLECT": ("READ_ONLY", "EVIDENCE_BASED"),
}


def _some(pairs) -> Column:
    """Labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in pairs]))


def intent(text: Column, explicit: Column, read_only: Column) -> Column:
    low = F.lower(text)
    chosen = F.when(F.upper(explicit).isin(*INTENTS), F.upper(explicit))
    for label, words in INTENT_WORDS:
        chosen = chosen.when(contains_any(low, words), label)
    return chosen.when(read_only, "RESEARCH").otherwise("")


def alerts(text: Column, read_only: Column) -> Column:
    (m, mw), (g, gw), (n, nw) = ALERT_WORDS
    return _some([(m, ~read_only & contains_any(text, mw)), (g, contains_any(text, gw)), (n, ~read_only & contains_any(F.lower(text), nw))])


def guardrails(label: Column, read_only: Column) -> Column:
    table = F.create_map(*[x for k, v in GUARDRAILS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.element_at(table, label), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(read_only, F.array(F.lit("READ_ONLY"))).otherwise(F.array().cast("array<string>")), own))


def side_effects(text: Column) -> Column:
    found, low = tokens(text), F.lower(text)

    def score(strong, weak, part) -> Column:
        s = F.when(F.arrays_overlap(found, F.array(*map(F.lit, strong))), 2).otherwise(0)
        if weak:
            s = s + F.when(F.arrays_overlap(found, F.array(*map(F.lit, weak))), 1).otherwise(0)
        if part:
            s = s + F.when(contains_any(low, part), 1).otherwise(0)
        return s

    return _some([(label, score(strong, weak, part) >= least) for label, least, strong, weak, part in EFFECTS])


def stages(text: Column) -> Column:
    low = F.lower(text)
    return _some([(label, contains_any(low, words)) for label, words in STAGES])


def kind(symbol_type: Column) -> Column:
    t = F.lower(F.trim(symbol_type))
    return (
        F.when((t == "") | t.isNull() | t.isin(*CALLABLE), "callable")
        .when(t.isin(*TYPE_LIKE), "type")
        .when(contains_any(t, ("module", "package", "namespace")), "module")
        .otherwise("other")
    )


def kind_priority(name: Column) -> Column:
    return F.when(name == "callable", 0).when(name == "type", 1).when(name == "module", 2).otherwise(3)


def complexity_level(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 30, "Medium").otherwise("Low")


def naming_style(name: Column) -> Column:
    return (
        F.when(name.contains("_") & (F.lower(name) == name), "snake")
        .when(name.rlike("^[a-z][a-zA-Z0-9]*$") & ~name.contains("_"), "camel")
        .otherwise("other")
    )


def naming_prefix(name: Column) -> Column:
    return F.when(name.contains("_"), F.concat(F.substring_index(name, "_", 1), F.lit("_"))).when(name.rlike("^get[A-Z]"), "get")


def uri_path(uri: Column) -> Column:
    path = F.regexp_replace(uri, "^file://", "")
    return F.try_url_decode(F.regexp_replace(path, "^/(?=[A-Za-z]:)", ""))


def normalised_time(raw: Column) -> Column:
    """Times of either layout as ISO with Z, as they are said; nothing counts as the first of 1970."""
    plain = F.trim(F.coalesce(raw, F.lit("")))
    full = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"
    return F.when(plain == "", "1970-01-01T00:00:00Z").when(plain.rlike(full), F.concat(F.translate(plain, " ", "T"), F.lit("Z"))).otherwise(plain)


def cut_bytes(text: Column, n: int) -> Column:
    """At most the first ``n`` bytes, marked where something is missing; a character cut in two is dropped."""
    raw = F.encode(text, "UTF-8")
    kept = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(min(4, n))])
    return F.when(F.length(raw) > n, F.concat(kept, F.lit("..."))).otherwise(text)


def union_distinct(*lists: Column) -> Column:
    """The items of all lists in order, each once, without a leading point; empty ones go."""
    items = F.transform(F.concat(*lists), lambda x: F.regexp_replace(x, r"^\.", ""))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def json_list(text: Column) -> Column:
    """The elements of a JSON list, objects as JSON; null for anything else."""
    return F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))


def json_or_raw(text: Column) -> Column:
    """A struct of what a JSON object holds, by key, or else of the text as it is."""
    held = F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    return F.struct(held.alias("held"), F.when(held.isNull(), text).alias("raw"))


# The words of a step and the hint that they call for, the first fitting one.
MAP_WORDS = ("扫描", "map", "结构")
MAP_HINTS = (
    (("核对", "审核", "对比", "对齐"), " (用 full 模式查看完整代码)"),
    (("浏览", "快速"), " (用 overview 模式)"),
    (("",), " (用 standard 模式)"),
)
SEARCH_WORDS = ("搜索", "定位", "查找")
SEARCH_HINTS = ((("函数", "类"), " (设置 search_type=function)"),)
IMPACT_WORDS = ("影响", "依赖")
IMPACT_HINTS = (
    (("谁调用了", "被哪里"), " (设置 direction=backward)"),
    (("调用了谁", "会影响"), " (设置 direction=forward)"),
)


def step_hint(name: Column) -> Column:
    """A step's name with the option that its words call for."""
    low, hint = F.lower(name), None
    for words, hints in ((MAP_WORDS, MAP_HINTS), (SEARCH_WORDS, SEARCH_HINTS), (IMPACT_WORDS, IMPACT_HINTS)):
        for more, text in hints:
            fits = contains_any(low, words) & contains_any(low, more)
            hint = F.when(fits, text) if hint is None else hint.when(fits, text)
    return F.concat(name, hint.otherwise(""))
