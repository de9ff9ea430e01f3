"""Name and path rules as boolean or string columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secret names and patterns, vendored directories, generated files, lock files, languages.
SECRET_NAMES = (".env", ".npmrc", ".pypirc", ".netrc", ".git-credentials")
SECRET_GLOBS = (
    ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*", "*.tfvars",
    "credentials*.json", "service-account*.json",
)
VENDORED_DIRS = ("vendor", "node_modules", "dist", "build", ".git", "third_party")
GENERATED_GLOBS = ("*.min.js", "*_pb2.py", "*.pb.go")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum")
LANGUAGES = {".py": "python", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".md": "markdown"}
GENERATED_HEADER = r"^// Code generated .* DO NOT EDIT\.\r*$"
GENERATED_LINES = 20
NOISE_PATH = r"^((.*/)?(node_modules|vendor|dist|build|migrations|__pycache__|\.git)/.*|.*\.lock$|.*-lock\.json$)"
CONTROL_TEXT = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
DOC_EXTENSIONS = ("md", "mdx", "rst", "txt", "adoc")

#: Words of file and class names, first match wins, and what they say.
FILE_PURPOSES = (
    (("route", "api"), "API endpoint definitions"),
    (("model", "schema"), "Data model definitions"),
    (("service",), "Service layer implementation"),
    (("controller", "handler"), "Request handler implementation"),
    (("util", "helper"), "Utility functions"),
    (("config", "settings"), "Configuration"),
)
CLASS_PURPOSES = (
    (("service",), "Service class providing business logic"),
    (("controller", "handler"), "Request handler"),
    (("model", "schema"), "Data model"),
    (("repository", "repo"), "Data access layer"),
    (("manager",), "Management class"),
    (("helper", "util"), "Utility class"),
    (("builder",), "Builder pattern implementation"),
    (("factory",), "Factory pattern implementation"),
    (("validator",), "Validation logic"),
)


def glob_regex(globs: tuple[str, ...]) -> str:
    """One anchored alternation of ``*`` globs, readable by Java and RE2 alike."""
    return "^(" + "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\-", "-") for g in globs) + ")$"


SECRET_REGEX = glob_regex((*SECRET_NAMES, *SECRET_GLOBS))
GENERATED_REGEX = glob_regex(GENERATED_GLOBS)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda p: p != "")


def base_name(path: Column) -> Column:
    return F.get(F.reverse(path_parts(path)), 0)


def extension(name: Column) -> Column:
    """The last dot and what follows; none for a name that only starts with dots."""
    return F.regexp_extract(F.lower(name), r"[^.].*?(\.[^.]*)$", 1)


def is_secret_name(name: Column) -> Column:
    return F.lower(name).rlike(SECRET_REGEX)


def language_of(name: Column) -> Column:
    ext = extension(name)
    out = F.lit(None).cast("string")
    for known, language in LANGUAGES.items():
        out = F.when(ext == known, language).otherwise(out)
    return out


def classify_path(path: Column) -> Column:
    """struct(reason, language): the first rule that holds. Secret, vendored, generated, lock file, unsupported, indexable."""
    parts = path_parts(path)
    lowered = F.transform(parts, F.lower)
    name = F.get(F.reverse(lowered), 0)
    over = F.coalesce(F.get(F.reverse(lowered), 1), F.lit(""))
    dirs = F.slice(lowered, 1, F.greatest(F.size(lowered) - 1, F.lit(0)))
    language = language_of(name)
    reason = (
        F.when(F.size(parts) == 0, "unsafe_path")
        .when(name.rlike(SECRET_REGEX) | ((over == ".aws") & (name == "credentials")), "secret")
        .when(F.arrays_overlap(dirs, F.array(*map(F.lit, VENDORED_DIRS))), "vendored")
        .when(name.rlike(GENERATED_REGEX), "generated")
        .when(name.isin(*LOCK_FILES), "lockfile")
        .when(language.isNull(), "unsupported")
        .otherwise("indexable")
    )
    return F.struct(reason.alias("reason"), F.when(reason == "indexable", language).alias("language"))


def is_generated_source(content: Column) -> Column:
    """The generated-code header stands within the first 20 lines."""
    lines = F.slice(F.split(content, "\n"), 1, GENERATED_LINES)
    return F.exists(lines, lambda line: line.rlike(GENERATED_HEADER))


def unsafe_path(path: Column) -> Column:
    """Empty, a control character or backslash anywhere, absolute, a drive letter, or an empty, ``.`` or ``..`` segment."""
    marks = path.rlike(r"[\x00-\x1f\x7f-\x{9f}\\]")
    return (path == "") | marks | path.rlike(r"^([A-Za-z]:|/)") | F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", ".."))


def noise_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(NOISE_PATH)


def valid_query(text: Column, top_k: Column) -> Column:
    fine = F.length(text).between(1, 1000) & ~text.rlike(CONTROL_TEXT) & top_k.between(1, 50)
    return F.coalesce(fine, F.lit(False))


def parent_domains(email: Column) -> Column:
    """The domain of an address and all its parents."""
    labels = F.split(F.lower(F.trim(F.regexp_extract(email, r"@([^@]*)$", 1))), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def disposable_email(email: Column, domains: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parent_domains(email), F.array(*map(F.lit, domains)))


def _by_words(name: Column, table, otherwise: Column) -> Column:
    lower, out = F.lower(name), otherwise
    for words, purpose in reversed(table):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(lower, F.lit(w))
        out = F.when(found, purpose).otherwise(out)
    return out


def infer_file_purpose(name: Column, n_functions: Column, n_classes: Column) -> Column:
    shape = F.when(n_classes > n_functions, "Class definitions").when(n_functions > 0, "Function implementations").otherwise("Source file")
    test = F.contains(name, F.lit("_test")) | F.contains(name, F.lit(".test.")) | F.startswith(name, F.lit("test_"))
    return (
        F.when(test, "Test file")
        .when(name == "__init__.py", "Package initialization")
        .when(name.isin("main.go", "main.py"), "Application entry point")
        .otherwise(_by_words(name, FILE_PURPOSES, shape))
    )


def infer_class_purpose(name: Column) -> Column:
    return _by_words(name, CLASS_PURPOSES, F.concat(name, F.lit(" implementation")))


def ext_language(name: Column) -> Column:
    """Language by extension, or the bare extension."""
    return F.coalesce(language_of(name), F.regexp_replace(extension(name), r"^\.", ""))


def code_or_docs(name: Column) -> Column:
    return F.when(F.regexp_replace(extension(name), r"^\.", "").isin(*DOC_EXTENSIONS), "docs").otherwise("code")
