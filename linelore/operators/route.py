"""Which profile a command is reduced by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What runs another command: its own words are skipped. Fixed values.
WRAPPERS = ("env", "command", "nice", "nohup", "time", "sudo", "npx", "bunx", "exec")

# Profile -> the heads of its commands, with a subcommand where one decides. Fixed values of the registry.
PROFILES: dict[str, tuple[str, ...]] = {
    "go-test-json": ("go test",),
    "go-build": ("go build", "go install"),
    "go-lint": ("go vet", "golangci-lint", "staticcheck"),
    "go-mod": ("go mod", "go get"),
    "directory-listing": ("ls", "tree"),
    "cat-read": ("cat", "bat", "head", "tail", "less"),
    "ripgrep": ("rg",),
    "grep": ("grep", "egrep", "git grep"),
    "path-find": ("find", "fd"),
    "git-ls-files": ("git ls-files",),
    "git-status": ("git status",),
    "git-log": ("git log",),
    "git-diff": ("git diff",),
    "git-show": ("git show",),
    "git-add": ("git add",),
    "git-commit": ("git commit",),
    "git-push": ("git push",),
    "git-pull": ("git pull",),
    "git-branch": ("git branch",),
    "git-fetch": ("git fetch",),
    "git-clone": ("git clone",),
    "git-merge": ("git merge",),
    "git-rebase": ("git rebase",),
    "git-checkout": ("git checkout", "git switch"),
    "git-reset": ("git reset", "git restore"),
    "git-stash": ("git stash",),
    "gh-pr-view": ("gh pr view",),
    "gh-pr-checks": ("gh pr checks",),
    "gh-item-list": ("gh pr list", "gh issue list"),
    "gh-run-log": ("gh run watch",),
    "gh-run-list": ("gh run list",),
    "gh-run-view": ("gh run view",),
    "gh-api": ("gh api",),
    "glab-pipeline": ("glab pipeline", "glab ci"),
    "bun-test": ("bun test",),
    "vitest-json": ("vitest",),
    "jest-json": ("jest",),
    "node-eval": ("node",),
    "js-workspace": ("npm", "pnpm", "yarn", "tsc", "eslint", "bun"),
    "js-package-test": ("npm test", "pnpm test", "yarn test", "npm run test", "pnpm run test"),
    "pytest": ("pytest", "py.test"),
    "python-tooling": ("ruff", "mypy", "black", "flake8", "pylint"),
    "cargo-test": ("cargo test", "cargo nextest"),
    "cargo-build": ("cargo build", "cargo check", "cargo clippy"),
    "dotnet-test": ("dotnet test",),
    "dotnet-build": ("dotnet build",),
    "gradle-build": ("gradle", "gradlew", "./gradlew"),
    "build-system": ("terraform", "tofu", "cmake", "ninja", "bazel", "mvn", "docker build"),
    "pulumi-diff": ("pulumi",),
    "ctest": ("ctest",),
    "clang-tooling": ("clang", "clang++", "clang-tidy", "clang-format"),
    "php-tooling": ("php", "phpunit", "phpstan", "composer"),
    "patch-diff": ("patch", "diff"),
    "docker-images": ("docker images",),
    "docker-transfer": ("docker pull", "docker push"),
    "docker-activity": ("docker compose",),
    "docker-ps": ("docker ps",),
    "docker-logs": ("docker logs",),
    "kubectl-get": ("kubectl get",),
    "kubectl-describe": ("kubectl describe",),
    "kubectl-logs": ("kubectl logs",),
    "kubectl-top": ("kubectl top",),
    "kubectl-events": ("kubectl events",),
    "kubectl-apply": ("kubectl apply",),
    "kubectl-rollout": ("kubectl rollout",),
    "kubectl-diff": ("kubectl diff",),
    "aws-log-events": ("aws logs filter-log-events",),
    "aws-lambda-functions": ("aws lambda list-functions",),
    "aws-stack-events": ("aws cloudformation describe-stack-events",),
    "aws-s3-ls": ("aws s3 ls",),
    "aws-ecs-state": ("aws ecs describe-services",),
    "vercel-deployments": ("vercel ls",),
    "cloud-list": ("aws", "gcloud", "az"),
    "supabase-function-logs": ("supabase functions logs",),
    "heroku-router-logs": ("heroku logs",),
    "cloud-logs": ("fly logs", "vercel logs"),
    "http-api": ("curl", "http", "wget"),
    "json-query": ("jq",),
    "sql-query": ("psql", "sqlite3", "mysql", "duckdb"),
    "csv-tabular": ("df", "du", "ps", "column"),
    "env-print": ("env", "printenv"),
}
BENIGN_EXITS = {"ripgrep": (1,), "grep": (1,), "patch-diff": (1,), "git-diff": (1,)}
TEST_WORDS = r"(?:^|[ :-])tests?(?:$|[ :])"


def unwrap(words: Column) -> Column:
    """A command without what merely runs it: ``env A=1 time cargo test`` is ``cargo test``."""
    idle = lambda w: w.isin(*WRAPPERS) | w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")
    first = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, w: F.when(a["go"] & idle(w), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("go"))))
    n = first["n"]
    return F.when((n > 0) & (n < F.size(words)), F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))).otherwise(words)


def profile(words: Column) -> Column:
    """The profile of a command's words: the longest known head counts; tests run by a package manager are tests; else ``generic-summary``."""
    table = F.create_map(*[F.lit(x) for p, heads in PROFILES.items() for h in heads for x in (h, p)])

    def of(w: Column) -> Column:
        key = lambda k: F.element_at(table, F.array_join(F.slice(w, 1, k), " "))
        tests = F.get(w, F.lit(0)).isin("npm", "pnpm", "yarn") & F.array_join(w, " ").rlike(TEST_WORDS)
        return F.when(tests, "js-package-test").otherwise(F.coalesce(key(3), key(2), key(1), F.lit("generic-summary")))

    # one binding keeps the words from being worked out again for each key
    return F.get(F.transform(F.array(unwrap(F.transform(words, F.lower))), of), F.lit(0))


def failed(exit_code: Column, profile_: Column) -> Column:
    """Whether an exit code means failure for a profile."""
    benign = F.lit(False)
    for p, codes in BENIGN_EXITS.items():
        benign = benign | ((profile_ == p) & exit_code.isin(*codes))
    return (exit_code != 0) & ~benign


def rule_matches(words: Column, cwd: Column, prefix: list[str] = (), all_args: list[str] = (), any_args: list[str] = (), exclude: list[str] = (), cwd_contains: str = "") -> Column:
    """Whether a project's own rule applies to a command."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    ok = F.lit(True)
    if prefix:
        ok &= F.slice(words, 1, len(prefix)) == arr(prefix)
    if all_args:
        ok &= F.size(F.array_except(arr(all_args), words)) == 0
    if any_args:
        ok &= F.arrays_overlap(words, arr(any_args))
    if exclude:
        ok &= ~F.arrays_overlap(words, arr(exclude))
    return ok & F.contains(F.coalesce(cwd, F.lit("")), F.lit(cwd_contains)) if cwd_contains else ok


def shell_words(command: Column) -> Column:
    """The words of a command line: quotes hold words together and go, a backslash keeps the next character; ``sh -c '...'`` is what it runs."""
    word = r"""((?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+)"""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"""'([^']*)'|"((?:[^"\\]|\\.)*)\"""", "$1$2"), r"\\(.)", "$1")

    def split(c: Column) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(word), F.lit(1)), bare)

    def inner(ws: Column) -> Column:
        shell = F.get(ws, F.lit(0)).isin("sh", "bash", "zsh") & F.get(ws, F.lit(1)).rlike("^-[a-z]*c$") & (F.size(ws) >= 3)
        return F.when(shell, split(F.get(ws, F.lit(2)))).otherwise(ws)

    return F.get(F.transform(F.array(split(command)), inner), F.lit(0))


def explain(df: DataFrame, command: str) -> DataFrame:
    """``command, words, profile, family``: how the router reads each command."""
    d = df.select(F.col(command).alias("command"), unwrap(F.transform(shell_words(F.col(command)), F.lower)).alias("words"))
    return d.select("command", F.array_join("words", " ").alias("words"), profile(F.col("words")).alias("profile"), F.coalesce(F.get("words", F.lit(0)), F.lit("")).alias("family"))


def rule_profiles(df: DataFrame, words: Column, cwd: Column, rules: list[dict], builtin: Column) -> DataFrame:
    """Adds ``profile``: the first of a project's rules that applies, else the builtin one. A rule's profile shadows a builtin of its name.

    A rule: ``profile`` and any of ``prefix, all_args, any_args, exclude, cwd_contains``.
    """
    out = builtin
    for r in reversed(rules):
        out = F.when(F.coalesce(rule_matches(words, cwd, **{k: v for k, v in r.items() if k != "profile"}), F.lit(False)), r["profile"]).otherwise(out)
    return df.withColumn("profile", out)
