"""Rule catalogues per language, the rule builder and the default rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.exprs import language_of
from lodegraph.operators.rules import Rule, violations

# Method names with a meaning of their own, which naming rules leave alone
PHP_RESERVED = [f"__{n}" for n in "construct destruct call callStatic get set isset unset sleep wakeup serialize unserialize toString invoke set_state clone debugInfo".split()]
PYTHON_OPERATORS = "add sub mul matmul truediv floordiv mod divmod pow lshift rshift and or xor".split()
PYTHON_RESERVED = [
    f"__{n}__"
    for n in "init new del repr str bytes format lt le eq ne gt ge hash bool getattr getattribute setattr delattr dir get set delete set_name init_subclass call len getitem setitem delitem iter reversed contains".split()
    + PYTHON_OPERATORS + [f"r{n}" for n in PYTHON_OPERATORS] + [f"i{n}" for n in PYTHON_OPERATORS] + "enter exit await aiter anext aenter aexit".split()
]
RESERVED = {"php": PHP_RESERVED, "typescript": ["constructor"], "javascript": ["constructor"], "python": PYTHON_RESERVED, "go": []}

# Name patterns
PASCAL, CAMEL, UPPER = "^[A-Z][a-zA-Z0-9]*$", "^[a-z][a-zA-Z0-9]*$", "^[A-Z][A-Z0-9_]*$"
_LAYERS = [{"name": "presentation", "paths": ["**/controllers/**", "**/pages/**", "**/components/**"]}, {"name": "application", "paths": ["**/services/**", "**/use-cases/**"]}, {"name": "domain", "paths": ["**/domain/**", "**/entities/**"]}, {"name": "infrastructure", "paths": ["**/repositories/**", "**/database/**"]}]


def _named(kind: str, pattern: str, **more) -> dict:
    return {"kind": kind, "pattern": pattern, **more}


# Codes, types, defaults and severities of the rules per language
PHP_RULES = [
    Rule("php:layer_boundary", "layer_boundary", {"source": "src/Domain/**", "forbidden": ["src/Infrastructure/**", "src/Infra/**"]}, "error"),
    Rule("php:layer_boundary_controllers_db", "layer_boundary", {"source": "src/**/Controller/**", "forbidden": ["src/**/Database/**", "src/**/Repository/**"]}, "warning"),
    Rule("php:naming_class", "naming_convention", _named("class", PASCAL), "warning"),
    Rule("php:naming_interface", "naming_convention", _named("interface", "^[A-Z][a-zA-Z0-9]*(Interface)?$"), "warning"),
    Rule("php:naming_trait", "naming_convention", _named("trait", "^[A-Z][a-zA-Z0-9]*(Trait)?$"), "warning"),
    Rule("php:naming_method", "naming_convention", _named("method", CAMEL, allowNames=PHP_RESERVED), "warning"),
    Rule("php:naming_function", "naming_convention", _named("function", CAMEL + "|^[a-z][a-z0-9_]*$"), "warning"),
    Rule("php:naming_constant", "naming_convention", _named("constant", UPPER), "warning"),
    Rule("php:forbidden_import_controllers", "forbidden_import", {"scope": "src/**/Controller/**", "forbidden": ["**/Database/**", "**/Repository/**", "**/Doctrine/**"]}, "warning"),
    Rule("php:forbidden_import_domain", "forbidden_import", {"scope": "src/Domain/**", "forbidden": ["**/Symfony/**", "**/Laravel/**", "**/Doctrine/**", "**/Illuminate/**"]}, "error"),
    Rule("php:forbidden_global_state", "forbidden_import", {"forbidden": ["$_GET", "$_POST", "$_SESSION", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES", "$_ENV", "$GLOBALS"]}, "warning"),
    Rule("php:max_complexity", "max_complexity", {"max": 10}, "warning"),
    Rule("php:max_complexity_strict", "max_complexity", {"max": 5}, "error"),
    Rule("php:max_parameters", "max_parameters", {"max": 5}, "warning"),
    Rule("php:max_parameters_strict", "max_parameters", {"max": 3}, "error"),
    Rule("php:max_lines", "max_lines", {"max": 50}, "warning"),
    Rule("php:max_lines_class", "max_lines", {"max": 300, "kind": "class"}, "warning"),
    Rule("php:missing_return_type", "missing_return_type", {"scope": "public"}, "warning"),
    Rule("php:missing_return_type_strict", "missing_return_type", {"scope": "all"}, "error"),
]
TYPESCRIPT_RULES = [
    Rule("typescript:naming_class", "naming_convention", _named("class", PASCAL), "warning"),
    Rule("typescript:naming_interface", "naming_convention", _named("interface", "^[A-Z][a-zA-Z0-9]*(Interface)?$"), "warning"),
    Rule("typescript:naming_type", "naming_convention", _named("type_alias", PASCAL), "warning"),
    Rule("typescript:naming_method", "naming_convention", _named("method", CAMEL), "warning"),
    Rule("typescript:naming_function", "naming_convention", _named("function", CAMEL), "warning"),
    Rule("typescript:naming_constant", "naming_convention", _named("constant", UPPER), "warning"),
    Rule("typescript:naming_variable", "naming_convention", _named("variable", CAMEL), "warning"),
    Rule("typescript:layer_boundary", "layer_boundary", {"layers": _LAYERS, "rules": {"presentation": ["application", "domain"], "application": ["domain"], "domain": [], "infrastructure": []}}, "error"),
    Rule("typescript:layer_boundary_strict", "layer_boundary", {"layers": _LAYERS, "rules": {"presentation": ["application"], "application": ["domain"], "domain": [], "infrastructure": []}}, "error"),
    Rule("typescript:forbidden_import_internal", "forbidden_import", {"forbiddenPatterns": ["**/internal/*", "**/private/*", "**/__internal/**"]}, "error"),
    Rule("typescript:forbidden_import_barrel", "forbidden_import", {"checkIndexImports": True}, "warning"),
    Rule("typescript:forbidden_import_external", "forbidden_import", {"allowedPackages": [], "forbiddenPackages": []}, "error"),
    Rule("typescript:max_complexity", "max_complexity", {"max": 10}, "warning"),
    Rule("typescript:max_complexity_strict", "max_complexity", {"max": 5}, "error"),
    Rule("typescript:max_parameters", "max_parameters", {"max": 5}, "warning"),
    Rule("typescript:max_parameters_strict", "max_parameters", {"max": 3}, "error"),
    Rule("typescript:max_lines", "max_lines", {"max": 50}, "warning"),
    Rule("typescript:max_lines_class", "max_lines", {"max": 200}, "warning"),
    Rule("typescript:missing_return_type", "missing_return_type", {"scope": "public"}, "warning"),
    Rule("typescript:missing_return_type_strict", "missing_return_type", {"scope": "all"}, "error"),
]
CATALOGUES = {"php": (PHP_RULES, ("php",)), "typescript": (TYPESCRIPT_RULES, ("typescript", "javascript"))}

# Rules where a project configures none
CONTAINER_RULES = [Rule("ClassNaming", "naming_convention", _named("class", PASCAL), "warning"), Rule("MethodNaming", "naming_convention", _named("method", CAMEL), "warning"), Rule("FunctionNaming", "naming_convention", _named("function", CAMEL), "warning")]


def reserved_names(languages: list[str]) -> list[str]:
    return list(dict.fromkeys(n for x in languages for n in RESERVED.get(x, [])))


def base_rules(languages: list[str], layers: bool = True, imports: bool = True, naming: bool = True, limits: bool = True, max_complexity: int = 10, max_parameters: int = 5, max_lines: int = 80, return_type: bool = False) -> list[Rule]:
    """The rules a project starts with; reserved names of its languages pass the naming rules."""
    allow = {"allowNames": reserved_names(languages)}
    groups = [
        (layers, [Rule("domain-no-infrastructure", "layer_boundary", {"source": "src/domain/**", "forbidden": ["src/infrastructure/**", "src/infra/**"]}, "error")]),
        (imports, [Rule("no-direct-db-in-controllers", "forbidden_import", {"scope": "src/**/controllers/**", "forbidden": ["**/db/**", "**/database/**"]}, "warning")]),
        (naming, [Rule(f"{kind}-{style}-case", "naming_convention", _named(kind, pattern, **allow), "warning") for kind, style, pattern in (("class", "pascal", PASCAL), ("method", "camel", CAMEL), ("function", "camel", CAMEL))]),
        (limits, [Rule("max-cyclomatic-complexity", "max_complexity", {"max": max_complexity}, "warning"), Rule("max-parameters", "max_parameters", {"max": max_parameters}, "warning"), Rule("max-lines", "max_lines", {"max": max_lines}, "warning")]),
        (limits and return_type, [Rule("require-return-type", "missing_return_type", {"scope": "public"}, "warning")]),
    ]
    return [r for on, rules in groups if on for r in rules]


def catalogue_violations(language: str, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of all rules of a language's catalogue among the files of that language.

    Boundary and import rules that state no ``forbidden`` find nothing, and kinds that the model
    does not know have no rows.
    """
    rules, languages = CATALOGUES[language]
    return violations(rules, symbols, edges).where(language_of("file").isin(*languages))


# Suffixes of class names per language, in order, and the kinds they stand for
KIND_SUFFIXES = {
    "php": [("event", "event"), ("listener subscriber", "listener"), ("handler", "handler"), ("controller", "controller"), ("service", "service"), ("repository", "repository"), ("factory", "factory"), ("middleware", "middleware"), ("provider", "provider"), ("dto request response", "dto"), ("entity model", "entity"), ("command", "command"), ("query", "query"), ("migration", "migration")],
    "go": [("service", "service"), ("repository repo store", "repository"), ("handler controller", "controller"), ("event", "event"), ("listener subscriber", "listener"), ("factory", "factory"), ("middleware", "middleware"), ("dto request response", "dto"), ("entity model", "entity"), ("command query", "command")],
    "python": [("service", "service"), ("repository repo", "repository"), ("controller view", "controller"), ("event", "event"), ("listener handler subscriber", "listener"), ("factory", "factory"), ("middleware", "middleware"), ("dto schema serializer", "dto"), ("entity model", "entity"), ("command usecase use_case", "command")],
    "csharp": [("service", "service"), ("repository repo", "repository"), ("controller", "controller"), ("event", "event"), ("handler listener", "listener"), ("factory", "factory"), ("middleware", "middleware"), ("dto request response viewmodel vm", "dto"), ("entity model", "entity"), ("command query", "command")],
}


def refined_kind(language: str, kind: str = "kind", name: str = "name", extends: str = "sym_extends", implements: str = "sym_implements"):
    """Kind of a class by the suffix of its name, in the order of the language; other kinds stay."""
    low = F.lower(name)
    out = F.when(~F.col(kind).isin(*(["class", "abstract_class"] if language == "php" else ["class"])), F.col(kind))
    for suffixes, to in KIND_SUFFIXES[language]:
        hit = low.rlike(f"({suffixes.replace(' ', '|')})$")
        if language == "php" and to == "event":
            hit = hit | F.coalesce(F.lower(extends).contains("event"), F.lit(False))
        out = out.when(hit, F.lit(to))
    if language == "php":
        out = out.when(F.exists(F.coalesce(implements, F.array().cast("array<string>")), lambda i: F.lower(i).rlike("listener|subscriber")), F.lit("listener"))
    return out.otherwise(F.col(kind))


def qualified_name(parent: str = "parent_name", name: str = "name", namespace: str = "bounded_context", language: str = "language_name"):
    r"""``Parent.name``; in PHP ``Namespace\name`` for what has no parent."""
    ns = F.nullif(F.coalesce(F.col(namespace), F.lit("")), F.lit(""))
    php = F.col(language).eqNullSafe(F.lit("php"))
    return F.when(F.col(parent).isNotNull(), F.concat(F.col(parent), F.lit("."), F.col(name))).when(php & ns.isNotNull(), F.concat(ns, F.lit("\\"), F.col(name))).otherwise(F.col(name))
