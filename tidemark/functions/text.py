"""Column functions over command and commit text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, needed for equal results.
NOISE = ["cd", "ls", "pwd", "clear", "history", "exit", "q", "docker ps", "docker images", "docker logs", "docker stop", "docker restart", "docker system prune -a", "git status", "git branch", "git log", "git diff", "git stash", "top", "htop", "whoami"]
NOISE_STARTS = ["cd", "ls"]
NOISE_PREFIXES = ["docker logs", "docker exec", "docker stop", "docker restart", "tail", "head", "cat", "grep", "wc", "sed", "echo", "find", "awk", "sort", "ssh", "scp", "mkdir", "touch", "rm", "mv", "cp", "chmod", "chown"]
HOOKS = ["_zellij", "zellij setup", "tmux set-environment", "prompt_command", "__vte_prompt_command", "kitty +kitten"]
COMMAND_CLASSES = {"git": ["git", "gh"], "docker": ["docker", "docker-compose"], "npm": ["npm", "yarn", "pnpm", "npx"], "python": ["python", "python3", "pip", "pip3", "pytest", "poetry"], "maven": ["mvn", "maven"], "vim": ["vim", "vi", "nano", "emacs"]}
FOCUS_LAYERS = {
    "UI Grid": ["tui", "ui", "css", "html", "style", "view", "window", "screen"],
    "Testing": ["test", "spec", "mock"],
    "Security": ["sanitizer", "auth", "security", "crypt", "secret", "token"],
    "Database Layer": ["db", "database", "sql", "model", "store", "query"],
    "Parser Engine": ["parser", "lexer", "ast"],
    "CLI Command Routing": ["cli", "main", "run", "cmd", "args"],
    "Network Layer": ["api", "client", "server", "http", "socket"],
}
BUILD_COMMANDS = ["make", "cmake", "ninja", "cargo build", "rustc", "go build", "gcc", "g++", "clang", "clang++", "tsc", "ts-node", "webpack", "vite build", "rollup", "esbuild", "swift build", "xcodebuild", "mvn compile", "gradle build", "dotnet build", "msbuild", "ant", "bazel build", "buck build", "scons", "meson"]
TAGS = {
    "deploy": (
        ["deploy(ment)?", "publish", "release", "kubectl", "helm", "vercel", "flyctl", "gcloud", "aws s3 sync", "capistrano", "shipit", "terraform apply", "gh release", "docker push"],
        ["deploy(ment)?", "publish", "release", "ship", "prod(uction)?"],
    ),
    "debug": (
        ["debug(ger)?", "pdb", "ipdb", "lldb", "gdb", "trace", "valgrind", "strace", "profile(r)?", "pyinstrument", "tcpdump", "doctor", "diagnose", "diagnostic", "journalctl", "dmesg", "docker logs"],
        ["debug(ger)?", "fix", "bug", "issue", "resolve(d)?", "crash(ed)?", "error", "workaround"],
    ),
    "setup": (
        ["setup", "install", "init", "create", "build", "configure", "make", "cmake", "clone", "venv", "virtualenv", "pip", "npm", "yarn", "pnpm", "poetry", "cargo"],
        ["setup", "init", "install", "configure", "add", "create", "config", "deps", "dependenc(y|ies)"],
    ),
    "test": (
        ["test(s|ing)?", "pytest", "unittest", "jest", "mocha", "tox", "coverage", "rspec", "cypress", "playwright"],
        ["test(s|ing)?", "spec", "coverage", "assert"],
    ),
    "docs": (
        ["docs?", "documentation", "readme", "wiki", "changelog", "sphinx", "mkdocs", "markdown", "md", "man", "tldr", "help"],
        ["docs?", "documentation", "readme", "wiki", "changelog", "typo", "comment"],
    ),
}
PROJECT_GIT = ["git commit", "git push", "git pull", "git merge", "git rebase", "git checkout", "git switch", "git stash", "git add", "git diff", "git branch", "git cherry-pick", "git reset", "git tag", "git fetch"]
PROJECT_TOOLS = ["npm", "npx", "yarn", "pnpm", "cargo", "gradle", "mvn", "docker-compose", "docker compose", "flutter", "rails", "bundle", "mix", "dotnet"]
PROJECT_STARTS = ["make", "python manage.py", "python setup.py", "pip install -e", "pytest", "python -m pytest", "python3 -m pytest", "go build", "go run", "go test"]
SUMMARY_LABEL = r"(?i)^(├─|└─|•|\*)\s*(🔨|🔧|🚀|🧠|🤖|📂|⌨️)?\s*(Built|Flow|Result|Story|Hacked|Tooling|Outcome|Project|Action|Pattern):\s*"
SUMMARY_SIGNS = "├─└─•* \t🔨🔧🚀🧠🤖"
NO_MEMORY = "Activity logged"
COMMIT_NOISE = [
    "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]", r":[a-z0-9_+-]+:", r"^(?:\[[A-Z]+-\d+\]|[A-Z]+-\d+:)\s*",
    r"^(?i:feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(?:\([^)]*\))?!?:\s*", r"\s*\(#\d+\)\s*$",
]
MESSAGE_FLAGS = [r"""(?:-a?s?m|--message)(?:\s+|=)["']([^"']+)["']""", r"""(?:-a?s?m|--message)(?:\s+|=)([^\s"']+)"""]
COMMIT_MESSAGES = [r"""-[a-z]*m\s*"((?:\\.|[^"\\])*)\"""", r"-[a-z]*m\s*'([^']*)'", r'--message[= ]"([^"]*)"', r"--message[= ]'([^']*)'", r"-m\s+(\S+)"]
GIT_WORDS = [
    (r"(?:checkout\s+-b|switch\s+-c)\s+(\S+)", "Create branch $1"),
    (r"(?:checkout|switch)\s+(\S+)", "Switch to branch $1"),
    ("push", "Push changes to remote"),
    ("pull", "Pull latest changes"),
    (r"rebase\s+(?:-i|--interactive)\s+HEAD~0*1(?!\d)", "Interactive rebase of last commit"),
    (r"rebase\s+(?:-i|--interactive)\s+HEAD~0*(\d+)", "Interactive rebase of last $1 commits"),
    (r"(?s)^(?!.*HEAD~\d).*rebase\s+(?:-i|--interactive)\s+", "Interactive rebase"),
    (r"(?<!-)rebase\s+(?:onto\s+)?(?!-i|--interactive\b)(\S+)", "Rebase onto $1"),
    ("cherry-pick", "Cherry-pick commit"),
    (r"reset\s+--hard\s*HEAD~0*1(?!\d)", "Hard reset to previous commit"),
    (r"reset\s+--hard\s*HEAD~0*(\d+)", "Hard reset $1 commits back"),
    (r"reset\s+--soft\s*HEAD~0*1(?!\d)", "Soft reset to previous commit"),
    (r"reset\s+--soft\s*HEAD~0*(\d+)", "Soft reset $1 commits back"),
    (r"reset\s+--mixed\s*HEAD~0*1(?!\d)", "Mixed reset to previous commit"),
    (r"reset\s+--mixed\s*HEAD~0*(\d+)", "Mixed reset $1 commits back"),
    (r"reset\s+HEAD~0*1(?!\d)", "Reset to previous commit"),
    (r"reset\s+HEAD~0*(\d+)", "Reset $1 commits back"),
]
# End of fixed values.


def whole_words(patterns: list[str]) -> str:
    return r"\b(?:" + "|".join(patterns) + r")\b"


def tag_flags(text: Column, of_commits: bool) -> dict[str, Column]:
    """For each tag, whether the text speaks of it."""
    return {tag: F.lower(text).rlike(whole_words(rules[int(of_commits)])) for tag, rules in TAGS.items()}


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\S+)", 1)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b" + r"(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")


def quotes_balanced(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\\.", "")
    return (F.regexp_count(bare, F.lit("'")) % 2 == 0) & (F.regexp_count(bare, F.lit('"')) % 2 == 0)


def strip_continuation(text: Column) -> Column:
    """Drop the last of an odd run of closing backslashes, unless it follows one of : " ' /"""
    run = F.length(F.regexp_extract(text, r"(\\+)$", 1))
    guarded = text.rlike(r"""[:"'/]\\+$""")
    return F.when((run % 2 == 1) & ~guarded, F.rtrim(F.substring(text, F.lit(1), F.length(text) - 1))).otherwise(text)


def clean_command(text: Column) -> Column:
    """One line without escapes and repeated white space; shell hooks become null."""
    joined = F.regexp_replace(strip_ansi(text), r"\\\n", " ")
    flat = F.trim(F.regexp_replace(joined, r"\s+", " "))
    cleaned = F.when(quotes_balanced(flat), strip_continuation(flat)).otherwise(flat)
    return F.when(~F.lower(cleaned).rlike("|".join(h.replace("+", r"\+") for h in HOOKS)), cleaned)


def split_chain(text: Column) -> Column:
    """Commands joined by &&, || or ; outside quotes, trimmed, without empty ones."""
    parts = F.split(text, r"""(?:&&|\|\||;)(?=(?:[^'"\\]|\\.|"(?:\\.|[^"\\])*"|'[^']*')*$)""")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_noise(text: Column) -> Column:
    """Navigation, inspection and utility commands; chains are work."""
    t = F.trim(text)
    low = F.lower(t)
    prefixed = low.rlike("^(?:" + "|".join(NOISE_STARTS) + r")[ \t]") | low.rlike("^(?:" + "|".join(NOISE_PREFIXES) + ") ")
    return (
        F.when((t == "") | low.isin(NOISE), True)
        .when(t.startswith("#") | t.startswith("```"), True)
        .when(t.contains("&&") | t.contains("; "), False)
        .otherwise(prefixed)
    )


def classify_command(text: Column) -> Column:
    first = F.lower(first_word(text))
    out = F.when(F.trim(text) == "", "other").when(F.lower(F.trim(text)).rlike(r"^docker\s+compose(\s|$)"), "docker")
    for name, words in COMMAND_CLASSES.items():
        out = out.when(first.isin(words), name)
    return out.otherwise(first)


def focus_layer(filename: Column) -> Column:
    low, out = F.lower(filename), None
    for name, parts in FOCUS_LAYERS.items():
        hit = low.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Core Logic")


def is_build(text: Column) -> Column:
    """A build tool as whole word; an open end needs white space or the end of the text."""
    escaped = "|".join(b.replace("+", r"\+") for b in BUILD_COMMANDS)
    return F.lower(text).rlike(rf"(?:^|\s)(?:{escaped})(?:\s|$)")


def humanize_project(path: Column) -> Column:
    """The last path part in words, each capitalised, without a leading filler word."""
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    words = F.regexp_replace(F.trim(F.regexp_replace(base, "[-_]+", " ")), r"^(?i:(?:my|project|learning|test) )+", "")
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def clean_commit(message: Column) -> Column:
    """Without emoji, :codes:, ticket numbers, conventional prefix and closing pull request number; first letter capital."""
    m = reduce(lambda t, pattern: F.trim(F.regexp_replace(t, pattern, "")), COMMIT_NOISE, message)
    m = F.trim(F.regexp_replace(m, r"\s+", " "))
    return F.concat(F.upper(F.substring(m, 1, 1)), F.substr(m, F.lit(2)))


def is_project_command(text: Column) -> Column:
    """Whether a command only makes sense inside a project: version control that writes, builds, tests."""
    t = F.trim(text)
    tool = reduce(Column.__or__, [t.startswith(f"{x} ") | (t == x) for x in PROJECT_TOOLS])
    return reduce(Column.__or__, [t.startswith(x) for x in [*PROJECT_GIT, *PROJECT_STARTS]], tool)


def commit_priority(message: Column) -> Column:
    """0 for features, 1 for fixes, 2 for refactoring, 3 for the rest."""
    low = F.lower(message)
    return F.when(low.startswith("feat"), 0).when(low.startswith("fix"), 1).when(low.startswith("refactor"), 2).otherwise(3)


def _memory_of_one(text: Column) -> Column:
    """A commit's message, a git command in words, or the command itself."""
    told = F.coalesce(*[F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, words)) for pattern, words in GIT_WORDS])
    message = F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in MESSAGE_FLAGS])
    flat = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(message.isNotNull(), F.trim(message)).otherwise(F.coalesce(F.when(F.trim(text).startswith("git "), told), flat))


def command_memory(text: Column) -> Column:
    """What a command did, in words; of a chain, what its last part that is no noise did."""
    own = _memory_of_one(text)
    flat = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    parts = split_chain(flat)
    last = F.try_element_at(F.filter(parts, lambda p: ~is_noise(p)), F.lit(-1))
    of_last = F.transform(F.array(last), _memory_of_one)[0]
    return F.when((own == flat) & (F.size(parts) > 1), F.coalesce(of_last, flat)).otherwise(own)


def commit_message_in(command: Column) -> Column:
    """The message that a commit command gives, or null; the first form that fits wins."""
    found = [F.nullif(F.regexp_extract(command, f, 1), F.lit("")) for f in COMMIT_MESSAGES]
    return F.when(command.rlike(r"\bgit\s+commit\b"), F.coalesce(*found))


def summary_line(summary: Column) -> Column:
    """A summary's first line that says something once labels and signs before it are gone, else the summary without colours."""
    plain = strip_ansi(summary)
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~(x.startswith("[") & x.endswith("]")))
    bare = F.transform(lines, lambda x: F.ltrim(F.regexp_replace(x, SUMMARY_LABEL, ""), F.lit(SUMMARY_SIGNS)))
    return F.coalesce(F.get(F.filter(bare, lambda x: x != ""), 0), plain)


def entropy(text: Column) -> Column:
    """Shannon bits per character; 0 for an empty text."""
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    n = F.length(text).cast("double")

    def bits(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0), bits)


def file_arguments(text: Column) -> Column:
    """Words that look like files: with / or ., and neither flags, addresses, variables nor settings."""
    words = F.split(F.trim(text), r"\s+")
    words = F.slice(words, 2, F.size(words))
    return F.filter(words, lambda w: w.rlike(r"[/.]") & ~w.rlike(r"^-|://|[$=]"))


def markdown_fence(text: Column) -> Column:
    """Backticks, at least three and more than any run in the text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>()#+!|-])", r"\\$1")


def one_of(value: Column, ladder: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(ladder[0][0], ladder[0][1])
    for condition, name in ladder[1:]:
        out = out.when(condition, name)
    return out.otherwise(default)
