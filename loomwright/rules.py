"""Fixed values that results depend on: word lists, extensions, patterns and tables."""

from __future__ import annotations

#: Words that never become terms.
STOPWORDS = (
    "a an the in on at to of with by from as into through during before after above below between under over out up down off "
    "and or but nor so yet i you he she it we they me him her us them my your his its our their this that these those which who "
    "whom whose what where when how why is are was were be been being have has had having does did doing will would could should "
    "may might must shall can need dare ought not no yes all any both each few more most other some such than too very just also "
    "only own same then there here now always never ever about whether"
).split()

#: Extensions that make a word a file name.
FILE_EXTENSIONS = (
    "rs py js ts jsx tsx go java c cpp h hpp cs rb php swift kt scala clj ex exs erl hs ml fs r jl lua pl sh bash zsh vue svelte "
    "json yaml yml toml xml md txt css scss sass less html sql graphql proto"
).split()

#: Words of a question that don't name files.
QUESTION_WORDS = "the is a an where what how which are in for to".split()

#: File names that need their folder's name, and folders that don't help.
COMMON_NAMES = (
    "page.tsx page.ts page.jsx page.js index.tsx index.ts index.jsx index.js layout.tsx layout.ts route.tsx route.ts types.ts "
    "types.d.ts utils.ts helpers.ts constants.ts config.ts schema.ts mod.rs lib.rs main.rs __init__.py"
).split()
PLAIN_FOLDERS = "src lib app pages components".split()

#: What an import path may be completed with, in order.
IMPORT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/mod.rs"]

#: Methods a route file may export.
HTTP_METHODS = "GET POST PUT PATCH DELETE HEAD OPTIONS".split()

#: Terms of a question and what may stand in their place, in the order in which terms are tried.
EXPANSIONS: dict[str, list[str]] = {
    "architecture": ["structure", "layout", "design", "organization", "folder"],
    "structure": ["layout", "organization", "hierarchy"],
    "organization": ["structure", "layout", "folder"],
    "design": ["architecture", "pattern", "structure"],
    "pattern": ["design", "approach", "method", "strategy"],
    "approach": ["pattern", "method", "strategy", "technique"],
    "strategy": ["pattern", "approach", "method"],
    "flow": ["pipeline", "process", "sequence", "stream"],
    "pipeline": ["flow", "process", "chain", "workflow"],
    "workflow": ["flow", "process", "pipeline", "sequence"],
    "components": ["widgets", "elements", "ui", "views", "parts"],
    "modules": ["packages", "libraries", "crates", "units"],
    "features": ["functionality", "capabilities", "modules"],
    "connections": ["relationships", "links", "dependencies", "imports", "references"],
    "relationships": ["connections", "links", "associations", "bindings"],
    "dependencies": ["imports", "requires", "packages", "libraries"],
    "styling": ["styles", "css", "theme", "appearance", "visual", "tailwind"],
    "styles": ["css", "theme", "classes", "design"],
    "theme": ["styles", "colors", "appearance", "design"],
    "animations": ["transitions", "effects", "motion", "keyframes", "animate"],
    "configuration": ["config", "settings", "options", "env"],
    "settings": ["config", "options", "preferences"],
    "config": ["configuration", "settings", "options"],
    "authentication": ["auth", "login", "session", "credentials", "jwt"],
    "auth": ["authentication", "login", "session", "token"],
    "authorization": ["permissions", "roles", "access", "rbac"],
    "database": ["db", "storage", "persistence", "data"],
    "schema": ["model", "entity", "table", "structure"],
    "model": ["schema", "entity", "type", "interface"],
    "api": ["endpoints", "routes", "handlers", "services"],
    "endpoints": ["api", "routes", "handlers", "paths"],
    "routes": ["endpoints", "paths", "handlers", "api"],
    "tests": ["testing", "specs", "unit", "integration"],
    "testing": ["tests", "specs", "assertions", "mocks"],
    "types": ["interfaces", "schemas", "definitions", "models"],
    "interfaces": ["types", "contracts", "protocols", "apis"],
    "state": ["store", "context", "redux", "zustand", "data"],
    "store": ["state", "context", "data", "cache"],
}

#: Conventional commit kinds and their headings, in the order of a changelog.
COMMIT_KINDS: dict[str, str] = {
    "feat": "Features", "fix": "Bug Fixes", "perf": "Performance", "refactor": "Refactoring", "docs": "Documentation",
    "style": "Styles", "test": "Tests", "build": "Build", "ci": "CI", "chore": "Chores", "revert": "Reverts", "other": "Other",
}

#: Lock and manifest files, the manager they speak for, its ecosystem and its place (less is stronger).
LOCK_FILES = [
    ("pnpm-lock.yaml", "pnpm", "js", 1), ("yarn.lock", "yarn", "js", 2), ("bun.lockb", "bun", "js", 3), ("package-lock.json", "npm", "js", 4), ("package.json", "npm", "js", 10),
    ("Cargo.lock", "cargo", "rust", 1), ("Cargo.toml", "cargo", "rust", 10),
    ("uv.lock", "uv", "python", 1), ("poetry.lock", "poetry", "python", 2), ("Pipfile.lock", "pipenv", "python", 3), ("requirements.txt", "pip", "python", 10), ("pyproject.toml", "pip", "python", 11),
    ("go.sum", "go", "go", 1), ("go.mod", "go", "go", 10), ("Gemfile.lock", "bundler", "ruby", 1), ("Gemfile", "bundler", "ruby", 10), ("composer.lock", "composer", "php", 1), ("composer.json", "composer", "php", 10),
]

#: Extensions and languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "kt": "kotlin", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "sql": "sql", "md": "markdown", "css": "css", "scss": "scss",
    "sass": "sass", "less": "less", "html": "html", "htm": "html", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "sh": "shell", "bash": "shell", "swift": "swift",
    "scala": "scala", "lua": "lua", "r": "r", "jl": "julia", "hs": "haskell", "ex": "elixir", "exs": "elixir", "erl": "erlang", "clj": "clojure", "dart": "dart", "vue": "vue", "svelte": "svelte",
}

#: Extensions whose files belong to the docs base; all others are code.
DOC_EXTENSIONS = "md mdx markdown txt rst adoc pdf doc docx html htm json yaml yml toml xml ini csv".split()
ARCHIVES = "zip tar gz tgz bz2 xz 7z rar".split()

#: Technologies, as parts of names, and the further terms that they bring to a question.
STACK_EXPANSIONS: list[tuple[tuple[str, ...], dict[str, list[str]]]] = [
    (("react", "next"), {"components": ["tsx", "jsx", "react", "component"], "pages": ["app", "routes", "page.tsx", "layout"], "hooks": ["useState", "useEffect", "use", "custom"], "state": ["context", "provider", "store", "zustand"]}),
    (("vue",), {"components": ["vue", "component", "template"], "state": ["pinia", "vuex", "store", "composable"]}),
    (("angular",), {"components": ["component.ts", "template", "module"], "services": ["service.ts", "injectable", "provider"], "state": ["ngrx", "store", "service", "observable"]}),
    (("tailwind",), {"styling": ["tailwind", "className", "tw", "classes"], "styles": ["tailwind.config", "className", "utility"], "animations": ["animate", "transition", "duration", "ease"]}),
    (("prisma",), {"database": ["prisma", "schema.prisma", "model", "db"], "schema": ["prisma", "model", "relation", "@@"]}),
    (("typescript",), {"types": ["interface", "type", ".d.ts", "generic"]}),
    (("rust",), {"modules": ["mod.rs", "crate", "pub mod"], "types": ["struct", "enum", "trait", "impl"]}),
    (("python",), {"modules": ["__init__.py", "import", "package"], "types": ["class", "dataclass", "TypedDict", "Protocol"]}),
]

#: What a question says that wants everything of a kind, and what it calls the kinds (singulars stand for plurals, as parts of words).
#: What a question for everything contains.
ALL_MARKS = [
    "all ", "every ", "list ", "liste ", "show all", "mostre todos", "mostre todas", "quais são todos", "quais são todas", "todas as ", "todos os ", "what are all", "where are all", "find all", "get all", "list of all",
]
KIND_WORDS = {
    "endpoint": ["route", "rota", "endpoint", "api", "handler"],
    "function": ["function", "função", "funções", "method", "método"],
    "class": ["class", "classe", "type", "tipo", "interface"],
    "component": ["component", "componente"],
    "file": ["file", "arquivo", "module", "módulo"],
    "symbol": ["symbol", "símbolo", "definition", "definição", "definições"],
}
#: Kinds of nodes that a kind of question takes in, besides its own.
KIND_SYNONYMS = {
    "endpoint": ["route", "api"],
    "function": ["fn", "method"],
    "class": ["type", "interface", "struct", "entity"],
    "symbol": ["function", "fn", "method", "class", "type", "interface"],
}
#: Methods that a question may filter by, in the order in which they are looked for, and words that ask about endpoints.
ASKED_METHODS = ["get", "post", "put", "delete", "patch"]
ENDPOINT_WORDS = ["/api/", "endpoint", "route", "http", "get ", "post ", "put ", "delete ", "patch ", "rest ", "handler"]

#: Extensions and the tags of languages in the ids of symbols.
LANGUAGE_TAGS = {
    "ts": "ts tsx mts cts", "js": "js jsx mjs cjs", "py": "py pyw pyi", "rb": "rb rake gemspec", "cs": "cs", "java": "java", "md": "md markdown", "rs": "rs", "c": "c h",
    "cpp": "cpp hpp cc cxx hxx hh", "sql": "sql", "php": "php phtml", "go": "go", "kt": "kt kts", "css": "css scss sass less", "html": "html htm",
}

#: Statements that name another file, by extension; either of two groups holds the name.
IMPORT_PATTERNS = {
    "js jsx ts tsx mjs cjs": r"""(?:import\s+(?:.*?\s+from\s+)?['"]([^'"]+)['"])|(?:require\s*\(\s*['"]([^'"]+)['"]\s*\))""",
    "rs": r"(?:use\s+(?:crate|super|self)::([a-zA-Z_][a-zA-Z0-9_:]*)|mod\s+([a-zA-Z_][a-zA-Z0-9_]*))",
    "py": r"(?:^|\n)\s*(?:from\s+([a-zA-Z_][a-zA-Z0-9_.]*)|import\s+([a-zA-Z_][a-zA-Z0-9_.]*))",
}

#: Calls, class lists and library parts in scripts and pages.
DIRECT_CALL = {"js": r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", "py": r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "rs": r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:::<[^>]+>)?\s*\("}
METHOD_CALL = {
    "js": r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\.([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(",
    "py": r"\b([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    "rs": r"\b([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:::<[^>]+>)?\s*\(",
}
TYPE_CALL = r"\b([A-Z][a-zA-Z0-9_]*)::([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:::<[^>]+>)?\s*\("
JSX_CLASSES = r"""className\s*=\s*["']([^"']+)["']"""
JSX_CLASS_CALLS = r"""className\s*=\s*\{\s*(?:cn|clsx|classNames)\s*\(\s*["']([^"']+)["']"""
JSX_CLASS_TEMPLATES = r"className\s*=\s*\{\s*`([^`]+)`"
HTML_CLASSES = r"""class\s*=\s*["']([^"']+)["']"""
UI_IMPORT = r"""import\s*\{\s*([^}]+)\s*\}\s*from\s*["']@/components/ui/([^"']+)["']"""
NG_MODULE = r"@NgModule\s*\([^)]*\)\s*(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)"
NG_DECLARATIONS = r"declarations\s*:\s*\[\s*([^\]]+)\s*\]"
#: Names that aren't calls worth an edge, words that aren't calls, and objects whose methods aren't, by tag.
BUILT_IN = {
    "js": (
        "log error warn info debug trace dir table map filter reduce forEach find findIndex some every includes indexOf push pop shift unshift slice splice concat join reverse sort flat flatMap fill "
        "keys values entries assign freeze seal create hasOwnProperty toString valueOf split trim toLowerCase toUpperCase replace replaceAll substring substr charAt charCodeAt startsWith endsWith match "
        "search padStart padEnd then catch finally resolve reject all race allSettled floor ceil round abs min max random pow sqrt parse stringify getElementById querySelector querySelectorAll "
        "addEventListener removeEventListener createElement appendChild removeChild get set has delete clear add remove call apply bind useState useEffect useCallback useMemo useRef useContext useReducer "
        "useLayoutEffect useImperativeHandle useDebugValue"
    ),
    "py": (
        "print len range str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr open input format repr id hash dir vars globals locals iter next enumerate zip map "
        "filter sorted reversed min max sum abs round pow divmod all any callable super property staticmethod classmethod ord chr hex bin oct bytes bytearray append extend insert remove pop clear index "
        "count sort reverse copy get keys values items update setdefault split join strip lstrip rstrip lower upper title capitalize replace find rfind startswith endswith encode decode read write "
        "readline readlines close flush seek tell add discard union intersection difference __init__ __new__ __del__ __repr__ __str__ __call__"
    ),
    "rs": (
        "println print eprintln eprint format write writeln panic assert assert_eq assert_ne debug_assert debug_assert_eq todo unimplemented unreachable dbg vec format_args include_str include_bytes concat "
        "stringify env option_env cfg column file line module_path new default clone into from as_ref as_mut unwrap expect unwrap_or unwrap_or_else unwrap_or_default ok err map map_err and_then or_else "
        "ok_or ok_or_else is_some is_none is_ok is_err take replace len is_empty push pop insert remove contains get get_mut iter iter_mut into_iter collect filter fold find any all skip chain zip "
        "enumerate peekable to_string to_owned as_str as_bytes chars bytes parse from_str to_vec lock read write try_lock try_read try_write spawn join send recv try_recv eq ne lt le gt ge cmp "
        "partial_cmp add sub mul div rem neg not deref deref_mut index index_mut drop borrow borrow_mut"
    ),
}
NOT_CALLS = {
    "js": "if for while switch catch function async await return throw new typeof instanceof class const let var import export from require",
    "py": "if for while with try except finally def class lambda return yield raise import from as pass break continue and or not in is True False None",
    "rs": "if else for while loop match fn struct enum trait impl mod use pub let const static mut ref return break continue move async await where type unsafe extern crate self super dyn as in Some None Ok Err",
}
BUILT_IN_OBJECTS = {"js": "console Math JSON Object Array String Number Boolean Date Promise window document", "py": "os sys re json math random datetime time", "rs": ""}
BUILT_IN_TYPES = "Option Result Vec String Box Rc Arc Cell RefCell Mutex RwLock HashMap HashSet BTreeMap BTreeSet Path PathBuf File".split()
#: What tells a script's framework; the first that fits counts.
SCRIPT_FRAMEWORKS = [
    ("angular", ["@Component(", "@NgModule("]), ("next", ["from 'next", 'from "next']), ("shadcn", ["@/components/ui/", "from '@/components/ui"]),
    ("react", ["from 'react'", 'from "react"', "import React", "React.Component", "useState", "useEffect"]),
    ("express", ["express()", "from 'express'"]), ("angular", ["@angular/core", "@angular/common", "@Injectable("]),
]

#: Symbols by (language, kind, pattern, group of the name, names that don't count), in the order in which they are looked for.
#: Runs of words before a name are one word here: which name is found is the same, and the search takes no longer than the text.
SYMBOL_RULES: list[tuple[str, str, str, int, str]] = [
    ("python", "class", r"(?:^|\n)class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[:\(]", 1, ""),
    ("python", "function", r"(?:^|\n)(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, r"^__(?!init__$).*__$"),
    ("python", "method", r"(?:^|\n)[ \t]+(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, r"^__(?!init__$).*__$"),
    ("python", "constant", r"(?:^|\n)([A-Z][A-Z0-9_]*)\s*=", 1, "^[TKV]$"),
    ("rust", "struct", r"struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, ""),
    ("rust", "enum", r"enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, ""),
    ("rust", "trait", r"trait\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, ""),
    ("rust", "function", r"fn\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[<(]", 1, ""),
    ("rust", "module", r"mod\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[{;]", 1, "^tests?$"),
    ("rust", "type", r"type\s+([a-zA-Z_][a-zA-Z0-9_]*)(?:<[^>]+>)?\s*=", 1, ""),
    ("rust", "constant", r"(?:const|static(?:\s+mut)?)\s+([A-Z][A-Z0-9_]*)\s*:", 1, ""),
    ("go", "function", r"func\s+(?:\([^)]+\)\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, ""),
    ("go", "struct", r"type\s+([A-Z][a-zA-Z0-9_]*)\s+struct\b", 1, ""),
    ("go", "interface", r"type\s+([A-Z][a-zA-Z0-9_]*)\s+interface\b", 1, ""),
    ("go", "type", r"type\s+([A-Z][a-zA-Z0-9_]*)\s+(?!(?:struct|interface)(?![a-zA-Z0-9_\[\].]))[a-zA-Z]", 1, ""),
    ("go", "constant", r"const\s+([A-Z][a-zA-Z0-9_]*)\s*=", 1, ""),
    ("java", "class", r"class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("java", "record", r"record\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("java", "interface", r"interface\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("java", "enum", r"enum\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("java", "method", r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:\w+(?:<[^>]+>)?)\s+([a-z][a-zA-Z0-9_]*)\s*\(", 1, ""),
    ("kotlin", "class", r"class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("kotlin", "object", r"object\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("kotlin", "interface", r"interface\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("kotlin", "function", r"fun\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, ""),
    ("csharp", "class", r"class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("csharp", "interface", r"interface\s+(I[A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("csharp", "struct", r"struct\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("csharp", "enum", r"enum\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("csharp", "method", r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:virtual\s+)?(?:override\s+)?(?:\w+(?:<[^>]+>)?)\s+([A-Z][a-zA-Z0-9_]*)\s*\(", 1, r"^(?!Main$|Get[^_]*$)"),
    ("c", "function", r"\w++(?:\s*+\*)?\s++([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{", 1, "^(if|while|for|switch|return)$"),
    ("c", "struct", r"struct\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\{", 1, ""),
    ("c", "enum", r"enum\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\{", 1, ""),
    ("c", "typedef", r"typedef\s+.+?\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*;", 1, ""),
    ("c", "macro", r"#define\s+([A-Z_][A-Z0-9_]*)", 1, ""),
    ("cpp", "class", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, ""),
    ("cpp", "struct", r"struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, ""),
    ("cpp", "namespace", r"namespace\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\{", 1, ""),
    ("cpp", "function", r"\w++(?:<[^>]+>)?(?:\s*+\*)?(?:\s*+&)?\s++([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?\{", 1, "^(if|while|for|switch)$"),
    ("cpp", "enum", r"enum\s+(?:class\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*(?::\s*\w+\s*)?\{", 1, ""),
    ("ruby", "class", r"class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("ruby", "module", r"module\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("ruby", "method", r"def\s+(?:self\.)?([a-zA-Z_][a-zA-Z0-9_]*[!?]?)", 1, ""),
    ("ruby", "constant", r"([A-Z][A-Z0-9_]*)\s*=", 1, ""),
    ("php", "class", r"class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("php", "interface", r"interface\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("php", "trait", r"trait\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("php", "function", r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, "^__(?!construct$)"),
    ("sql", "table", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[`]?[a-zA-Z_][a-zA-Z0-9_]*[`]?\.)?[`]?([a-zA-Z_][a-zA-Z0-9_]*)[`]?", 1, ""),
    ("sql", "view", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?:[`]?[a-zA-Z_][a-zA-Z0-9_]*[`]?\.)?[`]?([a-zA-Z_][a-zA-Z0-9_]*)[`]?", 1, ""),
    ("sql", "function", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(?:[`]?[a-zA-Z_][a-zA-Z0-9_]*[`]?\.)?[`]?([a-zA-Z_][a-zA-Z0-9_]*)[`]?", 1, ""),
    ("sql", "procedure", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+(?:[`]?[a-zA-Z_][a-zA-Z0-9_]*[`]?\.)?[`]?([a-zA-Z_][a-zA-Z0-9_]*)[`]?", 1, ""),
    ("sql", "index", r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[`]?([a-zA-Z_][a-zA-Z0-9_]*)[`]?", 1, ""),
    *(("markdown", f"h{i}", rf"(?m)^#{{{i}}}\s+(.+)$", 1, "") for i in range(1, 7)),
    ("css", "styleClass", r"\.([a-zA-Z_][a-zA-Z0-9_-]*)", 1, "^(hover|focus|active|before|after|first-child|last-child|not)$"),
    ("css", "styleId", r"#([a-zA-Z_][a-zA-Z0-9_-]*)(?:\s*[:{>,\[\s]|$)", 1, ""),
    ("css", "cssVariable", r"--([a-zA-Z][a-zA-Z0-9_-]*)\s*:", 1, ""),
    ("css", "tailwindDirective", r"@tailwind\s+([a-zA-Z]+)", 1, ""),
    ("html", "htmlSection", r"""<(section|article|aside|header|footer|main|nav)\s+[^>]*id\s*=\s*["']([^"']+)["']""", 2, ""),
    ("html", "htmlAnchor", r"""<[a-zA-Z][a-zA-Z0-9]*\s+[^>]*id\s*=\s*["']([^"']+)["']""", 1, ""),
    ("script", "reactComponent", r"function\s+([A-Z][a-zA-Z0-9_$]*)\s*\([^)]*\)\s*(?::\s*[^{]+)?\s*\{", 1, "^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$"),
    ("script", "reactComponent", r"const\s+([A-Z][a-zA-Z0-9_$]*)\s*(?::\s*[^=]+)?\s*=\s*(?:React\.)?(?:memo|forwardRef)?\s*\(?\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_$][a-zA-Z0-9_$]*)\s*=>", 1, "^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$"),
    ("script", "reactComponent", r"class\s+([A-Z][a-zA-Z0-9_$]*)\s+extends\s+(?:React\.)?(?:Component|PureComponent)", 1, ""),
    ("script", "ngComponent", r"@Component\s*\(\s*\{[^}]*\}\s*\)\s*(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("script", "ngModule", r"@NgModule\s*\(\s*\{[^}]*\}\s*\)\s*(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("script", "ngService", r"@Injectable\s*\(\s*(?:\{[^}]*\})?\s*\)\s*(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)", 1, ""),
    ("script", "ngRoute", r"""\{\s*path\s*:\s*["']([^"']*)["']\s*,\s*(?:component|loadChildren|redirectTo)""", 1, "^$"),
    ("script", "function", r"function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", 1, r"^\p{Lu}.*\p{Ll}"),
    ("script", "function", r"const\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_$][a-zA-Z0-9_$]*)\s*=>", 1, r"^\p{Lu}.*\p{Ll}"),
    ("script", "class", r"class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", 1, ""),
    ("typescript", "interface", r"interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", 1, ""),
    ("typescript", "type", r"type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=", 1, ""),
]
#: Kinds that a file has once a name; what in a path tells of a part of a page.
ONCE = "styleClass styleId cssVariable tailwindDirective htmlSection htmlAnchor reactComponent ngComponent ngModule ngService ngRoute uiComponent".split()
PARTIAL_MARKS = ["partial", "layout", "template", "_", "component"]

#: Packages and what they tell, by ecosystem: kind, technology, packages (for Go: parts of module paths).
JS_TECHNOLOGIES = [
    ("framework", "Next.js", "next"), ("framework", "Nuxt", "nuxt nuxt3"), ("framework", "Remix", "@remix-run/react remix"), ("framework", "Astro", "astro"), ("framework", "SvelteKit", "@sveltejs/kit"),
    ("framework", "Gatsby", "gatsby"), ("framework", "RedwoodJS", "@redwoodjs/core"), ("framework", "React", "react"), ("framework", "Vue.js", "vue"), ("framework", "Angular", "angular @angular/core"),
    ("framework", "Svelte", "svelte"), ("framework", "SolidJS", "solid-js"), ("framework", "Preact", "preact"), ("framework", "Qwik", "@builder.io/qwik"), ("framework", "Lit", "lit lit-element"),
    ("framework", "Express", "express"), ("framework", "Fastify", "fastify"), ("framework", "NestJS", "@nestjs/core nest"), ("framework", "Hono", "hono"), ("framework", "Koa", "koa"), ("framework", "Hapi", "@hapi/hapi"),
    ("tool", "Jest", "jest"), ("tool", "Vitest", "vitest"), ("tool", "Mocha", "mocha"), ("tool", "Playwright", "playwright @playwright/test"), ("tool", "Cypress", "cypress"), ("tool", "Testing Library", "@testing-library/react"),
    ("tool", "Vite", "vite"), ("tool", "Webpack", "webpack"), ("tool", "esbuild", "esbuild"), ("tool", "Turborepo", "turbo"), ("tool", "tsup", "tsup"), ("tool", "Rollup", "rollup"), ("tool", "Parcel", "parcel"),
    ("tool", "Zustand", "zustand"), ("tool", "Jotai", "jotai"), ("tool", "Redux", "redux @reduxjs/toolkit"), ("tool", "MobX", "mobx"), ("tool", "Recoil", "recoil"), ("tool", "TanStack Query", "@tanstack/react-query react-query"),
    ("tool", "SWR", "swr"), ("tool", "Tailwind CSS", "tailwindcss"), ("tool", "Styled Components", "styled-components"), ("tool", "Emotion", "@emotion/react @emotion/styled"), ("tool", "Sass", "sass"),
    ("tool", "Chakra UI", "@chakra-ui/react"), ("tool", "Material UI", "@mui/material"), ("tool", "Ant Design", "antd"), ("tool", "Prisma", "prisma @prisma/client"), ("tool", "Drizzle", "drizzle-orm"), ("tool", "TypeORM", "typeorm"),
    ("tool", "Sequelize", "sequelize"), ("tool", "Knex", "knex"), ("tool", "Mongoose", "mongoose"), ("tool", "Kysely", "kysely"), ("tool", "tRPC", "@trpc/server @trpc/client"), ("tool", "GraphQL", "graphql"),
    ("tool", "Apollo", "@apollo/server @apollo/client"), ("tool", "URQL", "urql"), ("tool", "Auth.js", "next-auth @auth/core"), ("tool", "Passport", "passport"), ("tool", "Clerk", "@clerk/nextjs"),
    ("service", "Supabase", "@supabase/supabase-js"), ("service", "Firebase", "firebase firebase-admin"), ("service", "AWS S3", "@aws-sdk/client-s3"), ("service", "Stripe", "stripe"), ("tool", "Socket.IO", "socket.io socket.io-client"),
    ("tool", "WebSocket", "ws"), ("tool", "Nx", "nx"), ("tool", "Lerna", "lerna"), ("tool", "Storybook", "storybook @storybook/react"), ("tool", "TypeDoc", "typedoc"),
]
PYTHON_TECHNOLOGIES = [
    ("framework", "Django", "django"), ("framework", "Flask", "flask"), ("framework", "FastAPI", "fastapi"), ("framework", "Starlette", "starlette"), ("framework", "Litestar", "litestar"), ("framework", "Tornado", "tornado"),
    ("framework", "aiohttp", "aiohttp"), ("framework", "Sanic", "sanic"), ("framework", "Pyramid", "pyramid"), ("framework", "Bottle", "bottle"), ("framework", "Quart", "quart"), ("tool", "Celery", "celery"), ("tool", "RQ", "rq"),
    ("tool", "Dramatiq", "dramatiq"), ("tool", "SQLAlchemy", "sqlalchemy"), ("tool", "Alembic", "alembic"), ("tool", "Peewee", "peewee"), ("tool", "Tortoise ORM", "tortoise-orm"), ("tool", "Databases", "databases"),
    ("tool", "Psycopg", "psycopg2 psycopg"), ("tool", "PyMongo", "pymongo"), ("tool", "Redis-Py", "redis"), ("tool", "Pydantic", "pydantic"), ("tool", "Marshmallow", "marshmallow"), ("tool", "attrs", "attrs"), ("tool", "pytest", "pytest"),
    ("tool", "unittest", "unittest"), ("tool", "Hypothesis", "hypothesis"), ("tool", "Coverage.py", "coverage"), ("tool", "pandas", "pandas"), ("tool", "NumPy", "numpy"), ("tool", "SciPy", "scipy"), ("tool", "Matplotlib", "matplotlib"),
    ("tool", "Seaborn", "seaborn"), ("tool", "Plotly", "plotly"), ("tool", "Polars", "polars"), ("tool", "TensorFlow", "tensorflow tensorflow-gpu"), ("tool", "PyTorch", "torch pytorch"), ("tool", "scikit-learn", "scikit-learn sklearn"),
    ("tool", "Keras", "keras"), ("tool", "Transformers", "transformers"), ("tool", "LangChain", "langchain langchain-core"), ("service", "OpenAI", "openai"), ("service", "Anthropic", "anthropic"),
    ("tool", "Hugging Face", "huggingface-hub"), ("tool", "Requests", "requests"), ("tool", "HTTPX", "httpx"), ("tool", "Click", "click"), ("tool", "Typer", "typer"), ("tool", "Rich", "rich"),
]
RUST_TECHNOLOGIES = [
    ("framework", "Actix Web", "actix-web"), ("framework", "Axum", "axum"), ("framework", "Rocket", "rocket"), ("framework", "Warp", "warp"), ("framework", "Poem", "poem"), ("framework", "Tide", "tide"), ("tool", "Tokio", "tokio"),
    ("tool", "async-std", "async-std"), ("tool", "Serde", "serde"), ("tool", "serde_json", "serde_json"), ("tool", "Diesel", "diesel"), ("tool", "SQLx", "sqlx"), ("tool", "SeaORM", "sea-orm"), ("tool", "rusqlite", "rusqlite"),
    ("tool", "MongoDB Rust", "mongodb"), ("tool", "redis-rs", "redis"), ("tool", "clap", "clap"), ("tool", "StructOpt", "structopt"), ("tool", "reqwest", "reqwest"), ("tool", "Hyper", "hyper"), ("tool", "Askama", "askama"),
    ("tool", "Tera", "tera"), ("tool", "Handlebars", "handlebars"), ("tool", "Criterion", "criterion"), ("tool", "proptest", "proptest"), ("tool", "tracing", "tracing"), ("tool", "log", "log"),
]
GO_TECHNOLOGIES = [
    ("framework", "Gin", "github.com/gin-gonic/gin"), ("framework", "Fiber", "github.com/gofiber/fiber"), ("framework", "Echo", "github.com/labstack/echo"), ("framework", "Gorilla Mux", "github.com/gorilla/mux"),
    ("framework", "Chi", "github.com/go-chi/chi"), ("framework", "Beego", "github.com/beego/beego"), ("tool", "Hugo", "github.com/gohugoio/hugo"), ("tool", "GORM", "gorm.io/gorm"), ("tool", "sqlx", "github.com/jmoiron/sqlx"),
    ("tool", "go-pg", "github.com/go-pg/pg"), ("tool", "MongoDB Go", "go.mongodb.org/mongo-driver"), ("tool", "go-redis", "github.com/redis/go-redis"), ("tool", "Testify", "github.com/stretchr/testify"),
    ("tool", "Ginkgo", "github.com/onsi/ginkgo"), ("tool", "Cobra", "github.com/spf13/cobra"), ("tool", "urfave/cli", "github.com/urfave/cli"), ("tool", "gRPC Go", "google.golang.org/grpc"), ("tool", "Zap", "go.uber.org/zap"),
    ("tool", "Logrus", "github.com/sirupsen/logrus"),
]
RUBY_TECHNOLOGIES = [
    ("framework", "Ruby on Rails", "rails"), ("framework", "Sinatra", "sinatra"), ("framework", "Hanami", "hanami"), ("framework", "Roda", "roda"), ("framework", "Grape", "grape"), ("framework", "Padrino", "padrino"),
    ("tool", "Active Record", "activerecord"), ("tool", "Sequel", "sequel"), ("tool", "ROM", "rom-rb rom"), ("tool", "Mongoid", "mongoid"), ("tool", "Redis Ruby", "redis"), ("tool", "Sidekiq", "sidekiq"), ("tool", "Resque", "resque"),
    ("tool", "Delayed Job", "delayed_job"), ("tool", "GoodJob", "good_job"), ("tool", "RSpec", "rspec rspec-rails"), ("tool", "Minitest", "minitest"), ("tool", "Capybara", "capybara"), ("tool", "FactoryBot", "factory_bot factory_bot_rails"),
    ("tool", "GraphQL Ruby", "graphql-ruby graphql"), ("tool", "Jbuilder", "jbuilder"), ("tool", "Devise", "devise"), ("tool", "OmniAuth", "omniauth"), ("tool", "Webpacker", "webpacker"), ("tool", "Sprockets", "sprockets"),
]
PHP_TECHNOLOGIES = [
    ("framework", "Laravel", "laravel/framework"), ("framework", "Symfony", "symfony/symfony symfony/framework-bundle"), ("framework", "Slim", "slim/slim"), ("framework", "CakePHP", "cakephp/cakephp"), ("framework", "Yii", "yiisoft/yii2"),
    ("framework", "Laminas", "laminas/laminas-mvc"), ("framework", "CodeIgniter", "codeigniter4/framework"), ("tool", "Doctrine", "doctrine/orm"), ("tool", "Doctrine DBAL", "doctrine/dbal"), ("tool", "Eloquent", "illuminate/database"),
    ("tool", "PHPUnit", "phpunit/phpunit"), ("tool", "PHPSpec", "phpspec/phpspec"), ("tool", "Behat", "behat/behat"), ("tool", "Pest", "pestphp/pest"), ("tool", "Twig", "twig/twig"), ("tool", "Blade", "laravel/blade jenssegers/blade"),
    ("framework", "API Platform", "api-platform/core"), ("tool", "Fractal", "league/fractal"), ("tool", "Laravel Passport", "laravel/passport"), ("tool", "Laravel Sanctum", "laravel/sanctum"), ("tool", "Horizon", "laravel/horizon"),
    ("tool", "php-amqplib", "php-amqplib/php-amqplib"), ("tool", "Guzzle", "guzzlehttp/guzzle"), ("tool", "Monolog", "monolog/monolog"),
]
#: Paths and what they tell: pattern, kind, technology.
FILE_TAGS = [
    (r"(^|/)(docker-)?compose\.ya?ml$", "infra", "Docker Compose"), (r"(?i)(kubernetes|k8s)/.*(?-i)\.ya?ml$", "infra", "Kubernetes"), (r"(^|/)Chart\.ya?ml$", "infra", "Helm"),
    (r"(?i)\.github/workflows/.*(?-i)\.ya?ml$", "tool", "GitHub Actions"), (r"(^|/)\.gitlab-ci\.yml$", "tool", "GitLab CI"), (r"(?i)\.circleci/config\.yml", "tool", "CircleCI"), (r"(^|/)Jenkinsfile$", "tool", "Jenkins"),
    (r"\.tf$", "infra", "Terraform"), (r"(^|/)Pulumi\.ya?ml$", "infra", "Pulumi"), (r"(^|/)serverless\.ya?ml$", "infra", "Serverless Framework"), (r"(^|/)vercel\.json$", "infra", "Vercel"), (r"(^|/)netlify\.toml$", "infra", "Netlify"),
    (r"(^|/)fly\.toml$", "infra", "Fly.io"), (r"(^|/)(Makefile|makefile|GNUmakefile)$", "tool", "Make"), (r"(^|/)(justfile|Justfile|\.justfile)$", "tool", "Just"), (r"(^|/)Taskfile\.ya?ml$", "tool", "Task"), (r"(^|/)nx\.json$", "tool", "Nx"),
    (r"(^|/)turbo\.json$", "tool", "Turborepo"), (r"(^|/)lerna\.json$", "tool", "Lerna"),
]
