"""Rule tables over paths, names and symbols, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, last_segment

# -- Fixed values: the file classifier's names and patterns -----------------------------------
VENDOR_DIRS = ("node_modules", "vendor", "third_party", "thirdparty", ".venv", "venv", "env", ".env", "bower_components", "jspm_packages")
BUILD_DIRS = ("dist", "build", "out", "target", "bin", "obj", "__pycache__", ".pytest_cache", ".mypy_cache", "coverage", ".coverage", "htmlcov", ".next", ".nuxt", ".svelte-kit", "site-packages")
SKIP_DIRS = (".git", ".github", ".gitlab", ".svn", ".idea", ".vscode", ".vs")
DOC_DIRS = ("docs", "doc", "documentation", "wiki")
TEST_PATH = r"(?i)(^|/)(tests?/|__tests__/|test/|spec/|specs/|e2e/|integration/|unit/|fixtures?/|mocks?/|stubs?/|fakes?/)"
TEST_FILE = r"(?i)(^|/)(test_[^/]+|[^/]+_test|[^/]+\.test\.|[^/]+\.spec\.|[^/]+_spec\.|conftest\.|setup_tests?\.)([^/]*)$"
GENERATED_COMMENT = r"(?i)(generated by|do not edit|auto.?generated|this file was automatically generated|code generated by|generated code)"
GENERATED_PATH = r"(?i)(^|/)(generated/|gen/|auto_generated/|pb2\.py$|[^/]+\.pb\.go$|[^/]+_pb2\.|[^/]+\.generated\.|swagger_client/|openapi_client/|grpc_generated/)"
GENERATED_NAMES = ("schema_pb2.py", "schema_pb2_grpc.py")
MIGRATION_PATH = r"(?i)(^|/)(migrations?/|alembic/|flyway/|liquibase/|db/migrate/|database/migrations?/)"
MIGRATION_FILE = r"(?i)^\d{4,14}[_\-].+\.(py|sql|rb)$"
CONFIG_EXTENSIONS = (".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".json", ".env", ".properties")
CONFIG_NAMES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pyproject.toml", "setup.cfg", "setup.py", "poetry.lock",
    "Pipfile", "Pipfile.lock", "requirements.txt", "requirements-dev.txt", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock", "Makefile", "CMakeLists.txt", "meson.build",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".gitignore", ".gitattributes", ".editorconfig", ".eslintrc", ".prettierrc", ".babelrc",
    "tsconfig.json", "jsconfig.json", "jest.config.js", "jest.config.ts", "vitest.config.ts", "vitest.config.js", "next.config.mjs", "next.config.js", "vite.config.ts", ".importlinter",
)
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".adoc", ".tex")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".pdf", ".mp4", ".mp3", ".wav", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".tar", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".pyc", ".pyo", ".class", ".jar")
SOURCE_EXTENSIONS = (".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".cpp", ".c", ".cc", ".h", ".hpp", ".cs", ".rb", ".kt", ".swift", ".scala", ".php", ".r")
CATEGORIES = ("source", "test", "generated", "vendor", "migration", "config", "docs", "asset", "build", "unknown")

# -- Fixed values: languages, layers, models ---------------------------------------------------
LANGUAGES = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
FETCHED_EXTENSIONS = (".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".cpp", ".c", ".cs", ".rb")
CODE_EXTENSIONS = (*FETCHED_EXTENSIONS, ".kt", ".swift", ".scala", ".r", ".m")
LAYERS = (
    ("Domain", ("domain", "entities", "models", "model", "entity", "dto")),
    ("Application", ("application", "use_cases", "services", "service", "usecase")),
    ("Infra", ("infrastructure", "repository", "repositories", "persistence", "database", "dao")),
    ("Presentation", ("presentation", "routers", "controllers", "controller", "router", "handler")),
    ("Frontend", ("components", "frontend", "pages", "hooks", "features")),
    ("Shared", ("shared", "utils", "common", "config", "exception", "exceptions")),
)
LAYER_SUFFIXES = (("Infra", "repository|dao"), ("Application", "service|usecase"), ("Presentation", "controller|handler|router"), ("Domain", "entity|model|dto"), ("Shared", "exception|config|util"))
DIAGRAM_SKIP_FILES = ("__init__.py", "__init__.ts", "index.ts", "index.js", "conftest.py")
DIAGRAM_SKIP_DIRS = ("__pycache__", ".git", "node_modules", ".venv", "venv", "dist", "build", ".next", "coverage", ".pytest_cache")
MODEL_FILES = ("model.py", "models.py", "entity.py", "entities.py", "schema.py", "orm.py", "db.py")
MODEL_BASES = ("Base", "DeclarativeBase", "Model", "models.Model", "BaseEntity", "AbstractEntity")
MODEL_ANNOTATIONS = ("Entity", "Table", "MappedSuperclass", "mapped_column", "Column")
NO_FIELDS = ("__init__", "__str__", "__repr__", "__eq__", "__hash__", "save", "delete", "get", "create", "update")


def category(path: Column, first_line: Column | None = None) -> Column:
    """What kind of file a path names; the first rule that matches decides, directories from the left."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name, ext = F.element_at(parts, -1), extension(path)
    kinds = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.when(F.lower(p).isin(*VENDOR_DIRS), "vendor").when(F.lower(p).isin(*BUILD_DIRS, *SKIP_DIRS), "build").when(F.lower(p).isin(*DOC_DIRS), "docs"))
    outer = F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))
    header = F.lit(False) if first_line is None else F.coalesce(first_line.rlike(GENERATED_COMMENT), F.lit(False))
    rest = (
        F.when(ext.isin(*ASSET_EXTENSIONS), "asset")
        .when(name.isin(*CONFIG_NAMES) | (name.startswith(".") & ext.isin(*CONFIG_EXTENSIONS)), "config")
        .when(ext.isin(*DOC_EXTENSIONS), "docs")
        .when(path.rlike(MIGRATION_PATH) | name.rlike(MIGRATION_FILE), "migration")
        .when(path.rlike(GENERATED_PATH) | name.isin(*GENERATED_NAMES) | header, "generated")
        .when(path.rlike(TEST_PATH) | path.rlike(TEST_FILE), "test")
        .when(ext.isin(*SOURCE_EXTENSIONS), "source")
        .otherwise("unknown")
    )
    return F.coalesce(outer, rest)


def language(path: Column) -> Column:
    out = F.lit("unknown")
    for ext, name in LANGUAGES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


def idiomatic_short(name: Column, lang: Column) -> Column:
    single = F.length(name) == 1
    python = (single & F.lower(name).rlike("^[ijknxyzefghst]$")) | name.isin("fn", "id", "db", "ok", "fs", "io", "ip")
    return F.when(lang == "python", python).when(lang.isin("java", "typescript", "javascript"), single & name.rlike("^[ijknxyz]$")).otherwise(True)


def naming_ok(name: Column, lang: Column, kind: Column) -> Column:
    """Whether a function, method or class name follows its language's convention."""
    pascal = name.rlike("^[A-Z][a-zA-Z0-9]*$")
    called = kind.isin("function", "method")
    python = F.when(called, name.rlike("^__[a-z][a-z0-9_]*__$|^_[a-z][a-z0-9_]*$|^[a-z_][a-z0-9_]*$") | idiomatic_short(name, lang)).when(kind == "class", name.rlike("^_[A-Z][a-zA-Z0-9]*$") | pascal).otherwise(True)
    camel = name.rlike("^[a-z][a-zA-Z0-9]*$") | idiomatic_short(name, lang)
    java = F.when(called, camel).when(kind == "class", pascal).otherwise(True)
    script = F.when(called, camel | pascal).when(kind == "class", pascal).otherwise(True)
    return F.when(lang == "python", python).when(lang == "java", java).when(lang.isin("typescript", "javascript"), script).otherwise(True)


def has_doc_support(lang: Column) -> Column:
    return lang.isin("python", "java", "typescript", "javascript")


def layer(path: Column) -> Column:
    """Architectural layer: a directory or file stem below the top, then the file name's suffix."""
    low = F.lower(F.translate(path, "\\", "/"))
    out = F.lit(None).cast("string")
    for name, fragments in LAYERS:  # the groups are in the order in which the fragments are tried
        out = F.coalesce(out, F.when(low.rlike(f"/({'|'.join(fragments)})[/.]"), name))
    stem = F.regexp_replace(last_segment(low), r"\.java|\.py|\.ts", "")
    for name, suffixes in LAYER_SUFFIXES:
        out = F.coalesce(out, F.when(stem.rlike(f"({suffixes})$"), name))
    return F.coalesce(out, F.lit("Other"))


def diagram_noise(label: Column, path: Column, lines: Column, classes: Column, functions: Column) -> Column:
    """Files that a diagram leaves out."""
    dirs = F.lit(False)
    for d in DIAGRAM_SKIP_DIRS:
        dirs = dirs | F.contains(path, F.lit(f"/{d}/"))
    return (
        label.isin(*DIAGRAM_SKIP_FILES)
        | dirs
        | path.rlike(r"(?i)(^|/)(tests?/|__tests__/|test_[^/]+\.|[^/]+_test\.[^/]+$)")
        | label.rlike(r"(?i)^(test_|.*_test$|conftest)")
        | label.rlike(r"(?i)^(tmp_|temp_|\.env|env\.|debug_|check_|rebuild_|run_)")
        | label.isin(".env", "env", ".env.local", ".env.example")
        | ((lines == 0) & (classes == 0) & (functions == 0))
    )


def is_model_class(path: Column, name: Column, bases: Column, decorators: Column) -> Column:
    lit_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    return last_segment(path).isin(*MODEL_FILES) | F.arrays_overlap(bases, lit_array(MODEL_BASES)) | F.arrays_overlap(decorators, lit_array(MODEL_ANNOTATIONS)) | name.rlike("(Model|Entity|Record|Schema|Table)$")


def field_type(name: Column) -> Column:
    """A column type guessed from a field's name; the first rule that matches decides."""
    low = F.lower(name)
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(low.endswith("_id") | (low == "id"), "String PK")
        .when(low.endswith("_at") | has("date", "time"), "DateTime")
        .when(has("email"), "String")
        .when(has("count", "num", "age"), "Integer")
        .when(has("is_", "has_", "enabled"), "Boolean")
        .when(has("price", "amount", "salary"), "Decimal")
        .when(has("url", "path", "description"), "Text")
        .otherwise("String")
    )


def fields_of(methods: Column) -> Column:
    """Fields of a model class from its short methods (structs with name and lines); three defaults without any; ten at most."""
    found = F.transform(F.filter(methods, lambda m: ~m["name"].isin(*NO_FIELDS) & (m["lines"] <= 5)), lambda m: F.struct(m["name"].alias("name"), field_type(m["name"]).alias("type"), (~m["name"].endswith("_id")).alias("nullable")))
    standard = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(o).alias("nullable")) for n, t, o in (("id", "String", False), ("created_at", "DateTime", False), ("updated_at", "DateTime", True))])
    return F.slice(F.when(F.size(found) > 0, found).otherwise(standard), 1, 10)


def is_route_file(path: Column) -> Column:
    return F.contains(path, F.lit("router")) | F.contains(F.lower(path), F.lit("controller"))


def repo_parts(url: Column) -> Column:
    """owner and name of a repository's URL; an error where it has not both."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), r"^[a-z]+://[^/]+/", "")
    parts = F.split(plain, "/")
    bad = F.raise_error(F.concat(F.lit("no repository URL: "), url)).cast("struct<owner:string,name:string>")
    return F.when((F.size(parts) < 2) | (F.get(parts, F.lit(0)) == "") | (F.get(parts, F.lit(1)) == ""), bad).otherwise(F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name")))
