"""Path predicates and transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a source scan leaves out, how names map to languages, and names of entry points, barrels and hubs.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "target", "out", ".next", "__pycache__", ".venv", "venv", "coverage", ".agents")
SKIP_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock")
SECRET_NAMES = (".npmrc", ".pypirc", ".netrc", "_netrc", ".pgpass", ".htpasswd", "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "secrets.yml", "secrets.yaml")
SECRET_EXTENSIONS = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".ppk")
PUBLIC_ENV = ("example", "sample", "template", "dist")
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "svgz", "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "webm", "avi", "mov", "pdf", "zip",
    "gz", "tar", "7z", "rar", "exe", "dll", "so", "dylib", "bin", "wasm", "class", "jar", "pyc", "o", "a", "obj", "pdb", "db", "sqlite",
)
LANGUAGES = {
    "javascript": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"),
    "sfc": ("vue", "svelte"),
    "python": ("py",),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "c": ("c", "h"),
    "cpp": ("cpp", "hpp", "cc", "cxx", "hh", "hxx"),
    "swift": ("swift",),
    "php": ("php",),
    "csharp": ("cs",),
    "html": ("html", "htm"),
    "sql": ("sql",),
    "prisma": ("prisma",),
    "graphql": ("graphql", "gql"),
    "dockerfile": ("dockerfile",),
    "markdown": ("md", "mdx"),
}
ENTRY_POINTS = (
    "src/App.tsx", "src/App.jsx", "src/main.tsx", "src/main.jsx", "src/main.ts", "src/main.js", "src/index.tsx", "src/index.jsx", "src/main.rs",
    "app/page.tsx", "app/layout.tsx", "pages/index.tsx", "pages/_app.tsx",
)
BARREL_NAMES = ("mod.rs", "__init__.py", "index.d.ts", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs")
HUB_NAMES = (
    "types.ts", "types.d.ts", "index.ts", "index.d.ts", "mod.rs", "lib.rs", "__init__.py", "types.py", "utils.py", "helpers.py", "constants.py", "types.go", "helpers.go",
    "utils.go", "constants.ts", "constants.rs", "errors.ts", "errors.rs", "utils.ts", "helpers.ts", "utils.rs", "Util.java", "Utils.java", "Constants.java", "Common.cs", "Utils.cs",
)
#: Larger files keep their row, but nothing is extracted from them.
MAX_SOURCE_BYTES = 1_000_000


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path before the last slash; "." without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """Lower-case extension; empty for none and for dotfiles without another dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("int")


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))


def is_secret(name: Column) -> Column:
    """Whether a file of this name holds credentials; checked-in environment templates don't."""
    env = (name == ".env") | name.startswith(".env.")
    lower = F.lower(name)
    by_extension = F.lit(False)
    for ending in SECRET_EXTENSIONS:
        by_extension = by_extension | lower.endswith(ending)
    return F.when(env, ~F.substring_index(name, ".", -1).isin(*PUBLIC_ENV)).otherwise(name.isin(*SECRET_NAMES) | by_extension)


def language(path: Column) -> Column:
    name, own = basename(path), extension(path)
    out = F.when(name == "Cargo.toml", "rust").when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile")
    for label, endings in LANGUAGES.items():
        out = out.when(own.isin(*endings), label)
    return out.otherwise("other")


def is_indexed(path: Column) -> Column:
    """Whether a scan keeps the file."""
    return ~(in_skipped_dir(path) | basename(path).isin(*SKIP_FILES) | is_secret(basename(path)) | extension(path).isin(*BINARY_EXTENSIONS))


def is_supported(path: Column) -> Column:
    """Whether a change of the file matters: kept by a scan and of a known language."""
    return is_indexed(path) & (language(path) != "other")


def is_test(path: Column) -> Column:
    path = slashed(path)
    name = basename(path)
    return (
        name.contains(".test.") | name.contains(".spec.") | name.endswith("_test.go") | name.endswith("_test.py") | name.endswith("_test.rs")
        | path.startswith("tests/") | path.contains("/tests/") | path.startswith("__tests__/") | path.contains("/__tests__/")
    )


def is_entry_point(path: Column) -> Column:
    path = slashed(path)
    return path.isin(*ENTRY_POINTS) | path.startswith("src/bin/")


def is_barrel(path: Column, n_symbols: Column, out_degree: Column) -> Column:
    """A file that only re-exports: a conventional name, no symbols, two or more dependencies."""
    return basename(path).isin(*BARREL_NAMES) & (n_symbols == 0) & (out_degree >= 2)


def is_dampened_hub(path: Column, in_degree: Column, n_files: Column) -> Column:
    """Imported by over 15 % of at least 20 files, or of a conventional name."""
    return ((n_files >= 20) & (in_degree > n_files * 0.15)) | basename(slashed(path)).isin(*HUB_NAMES)


def normalize_scope(scope: str) -> str:
    out = scope.strip().replace("\\", "/")
    while out.startswith("./"):
        out = out[2:]
    return out.rstrip("*").rstrip("/")


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or what is below it, never a sibling whose name begins alike."""
    prefix = normalize_scope(scope)
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def joined(base: Column, relative: Column) -> Column:
    """base/relative with "." and ".." resolved; null where it leaves the root."""
    parts = F.split(F.concat_ws("/", base, relative), "/")
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(done.isNull() | part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def ancestors(path: Column) -> Column:
    """All directories above the path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def candidates(lang: Column, stem: Column) -> Column:
    """Paths that an import of the stem may name, best first."""
    last, parent = F.substring_index(stem, "/", -1), F.regexp_replace(stem, "/[^/]*$", "")
    with_ = lambda *ends: [F.concat(stem, F.lit(e)) for e in ends]
    nested = F.instr(stem, "/") > 0
    rust = F.when(nested, F.array(stem, *with_(".rs", "/mod.rs"), F.concat(parent, F.lit(".rs")), F.concat(parent, F.lit("/mod.rs")))).otherwise(F.array(stem, *with_(".rs", "/mod.rs")))
    return (
        F.when(lang == "javascript", F.array(stem, *with_(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
        .when(lang == "python", F.array(stem, *with_(".py", "/__init__.py")))
        .when(lang == "rust", rust)
        .when(lang == "go", F.array(stem, *with_(".go"), F.concat(stem, F.lit("/"), last, F.lit(".go"))))
        .when(lang == "java", F.array(stem, *with_(".java")))
        .when(lang == "kotlin", F.array(stem, *with_(".kt")))
        .when(lang == "c", F.array(stem, *with_(".c", ".h")))
        .when(lang == "cpp", F.array(stem, *with_(".cpp", ".hpp", ".h")))
        .when(lang == "swift", F.array(stem, *with_(".swift")))
        .when(lang == "php", F.array(stem, *with_(".php")))
        .when(lang == "csharp", F.array(stem, *with_(".cs")))
        .when(lang == "html", F.array(stem, *with_(".html")))
        .when(lang == "sql", F.array(stem, *with_(".sql")))
        .when(lang == "prisma", F.array(stem, *with_(".prisma")))
        .when(lang == "markdown", F.array(stem, *with_(".md", ".markdown")))
        .otherwise(F.array(stem))
    )


def package_name(lang: Column, raw: Column) -> Column:
    """The external package that a specifier names."""
    scoped = raw.startswith("@") & (F.instr(raw, "/") > 0)
    return (
        F.when((lang == "javascript") & scoped, F.substring_index(raw, "/", 2))
        .when(lang == "javascript", F.substring_index(raw, "/", 1))
        .when(lang == "python", F.substring_index(raw, ".", 1))
        .otherwise(raw)
    )


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
