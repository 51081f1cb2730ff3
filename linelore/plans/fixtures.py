"""Invented outputs of 36 kinds of commands, with the fragments that a render must keep and its least savings and quality.

The kinds, sizes and gates are those of a command reducer's acceptance corpus; the texts are made here by rule.
"""

from __future__ import annotations

import json

NAMES = "amber birch cedar delta ember fjord grove heron iris jade kelp lotus maple north olive pearl quartz raven sage tulip umber violet willow yarrow zinnia".split()


def _n(i: int) -> str:
    return NAMES[i % len(NAMES)]


def _hex(i: int, size: int = 12) -> str:
    return "".join("0123456789abcdef"[(i * 7 + k * k * 5 + k) % 16] for k in range(size))


def _join(*parts) -> str:
    return "\n".join(x for p in parts for x in ([p] if isinstance(p, str) else p))


def _clock(i: int) -> str:
    return f"2025-09-02T10:{i // 60 % 60:02}:{i % 60:02}Z"


def _tests(n: int, package: str) -> list[str]:
    out = [json.dumps({"Action": "start", "Package": package})]
    for i in range(n):
        out += [json.dumps({"Action": a, "Package": package, "Test": f"Test{_n(i).title()}Round", "Elapsed": 0.01}) for a in ("run", "output", "pass")]
    return [*out, json.dumps({"Action": "pass", "Package": package, "Elapsed": 0.2})]


def _js_report(runner: str) -> str:
    bad = {"status": "failed", "fullName": "cart adds up the total", "title": "adds up the total", "failureMessages": [f"AssertionError: expected 41 to be 42\n    at /work/{runner}/src/cart.test.ts:17:22\n" + "\n".join(f"    at run (/work/node_modules/{runner}/dist/chunk-{_n(i)}.js:{i * 31 + 7}:13)" for i in range(6))]}
    good = [{"status": "passed", "fullName": f"cart keeps {_n(i)}", "title": f"keeps {_n(i)}", "failureMessages": []} for i in range(4)]
    return json.dumps({"numTotalTests": 5, "numPassedTests": 4, "numFailedTests": 1, "numPendingTests": 0, "numTotalTestSuites": 1, "numFailedTestSuites": 1, "success": False, "testResults": [{"name": f"/work/{runner}/src/cart.test.ts", "status": "failed", "assertionResults": [bad, *good]}]})


def _diff(files: int, lines: int) -> str:
    out = []
    for i in range(files):
        p = f"pkg/{_n(i)}/{_n(i + 3)}.go"
        out += [f"diff --git a/{p} b/{p}", f"index {_hex(i, 7)}..{_hex(i + 5, 7)} 100644", f"--- a/{p}", f"+++ b/{p}", f"@@ -{i + 1},{lines} +{i + 1},{lines + 1} @@ func {_n(i).title()}() error {{"]
        for k in range(lines):
            out += [f"-\tvalue{k} := load({k})", f"+\tvalue{k}, err := load(ctx, {k})"] if k % 2 == 0 else [f" \tuse(value{k})"]
    return _join(out)


def _plan() -> str:
    out = ["Terraform used the selected providers to generate the following execution plan.", "Resource actions are indicated with the following symbols:", "  + create", "  ~ update in-place", "", "Terraform will perform the following actions:", ""]
    for i in range(9):
        out += [f"  # aws_instance.{_n(i)} will be {'created' if i else 'updated in-place'}", f"  + resource \"aws_instance\" \"{_n(i)}\" {{", *(f"      + {a:<24} = (known after apply)" for a in ("ami", "arn", "availability_zone", "id", "instance_state", "private_ip", "public_ip")), "    }", ""]
    return _join(out, "Plan: 8 to add, 1 to change, 0 to destroy.")


def _service(n: int) -> list[str]:
    levels = ["INFO"] * 12 + ["DEBUG"] * 5 + ["WARN"]
    out = [f"{_clock(i * 3)} {levels[i % len(levels)]} {_n(i % 5)} pool refreshed in {i % 40}ms" for i in range(n)]
    return [*out[: n // 2], f"{_clock(1500)} ERROR payment gateway refused connection to 10.0.0.7:443", f"{_clock(1502)} FATAL ledger.go:88 journal is corrupt", *out[n // 2 :]]


def fixtures() -> list[tuple]:
    """``name, profile_name, command, exit_code, text, expected, min_savings, min_quality``."""
    f: list[tuple] = []

    def add(name: str, profile: str, command: str, code: int, text: str, expected: list[str], savings: float, quality: int) -> None:
        f.append((name, profile, command, code, text, expected, float(savings), quality))

    add("ls-listing", "directory-listing", "ls -p", 0, _join([f"{_n(i)}.md" for i in range(13)], [f"{_n(i + 4)}s/" for i in range(5)]), ["dirs:", "files:"], 20, 70)
    tree = ["."]
    for i in range(6):
        tree += [f"├── {_n(i)}", *(f"│   ├── {_n(i + k)}.go" for k in range(4))]
    add("tree-listing", "directory-listing", "tree", 0, _join(tree, "└── README.md", "", "6 directories, 25 files"), ["6 directories, 25 files", "README.md"], 15, 70)
    doc = ["# Harbour guide", "", "The harbour keeps boats of every size. It opens at dawn and is guarded at night by two keepers who walk the piers.", ""]
    for i in range(6):
        doc += [f"## {_n(i).title()} pier", f"Boats at the {_n(i)} pier pay weekly. The fee depends on the length of the boat, on the season and on the berth that was taken.", ""]
    add("read-markdown", "cat-read", "cat guide.md", 0, _join(doc), ["# Harbour guide"], 40, 80)
    add("vitest-direct-fail", "vitest-json", "vitest run --reporter=json", 1, _js_report("vitest"), ["cart adds up the total", "cart.test.ts"], 60, 85)
    add("jest-direct-fail", "jest-json", "jest --json", 1, _js_report("jest"), ["cart adds up the total"], 60, 85)
    cargo = ["running 12 tests", *(f"test store::{_n(i)} ... ok" for i in range(11)), "test store::total ... FAILED", "", "failures:", "", "---- store::total stdout ----", "thread 'store::total' panicked at src/store.rs:42:9:", "assertion `left == right` failed", "  left: 41", " right: 42", "note: run with `RUST_BACKTRACE=1`", "", "failures:", "    store::total", "", "test result: FAILED. 11 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out"]
    add("cargo-test-direct-fail", "cargo-test", "cargo test", 101, _join(cargo), ["store::total", "src/store.rs:42", "1 failed"], 50, 85)
    rg = [f"node_modules/{_n(i)}/dist/index.js:{i * 9 + 1}:module.exports = require('./{_n(i)}-{'x' * 40}')" for i in range(6)]
    add("ripgrep-noisy-matches", "ripgrep", "rg require", 0, _join(rg, "src/app.ts:3:const app = require('./app')", "src/app.ts:9:require('./env')"), ["src/app.ts"], 20, 75)
    add("find-noisy-paths", "path-find", "find .", 0, _join([f"./node_modules/{_n(i)}/package.json" for i in range(9)], "./src/app.ts", "./src/env.ts", "./README.md"), ["src/app.ts", "README.md"], 20, 75)
    add("clean-pass", "go-test-json", "go test -json ./...", 0, _join(_tests(9, "example.org/harbour/berth")), ["1 package"], 60, 95)
    noisy = [*(f"PASS src/{_n(i)}.test.js ({i}.12 s)" for i in range(20)), "FAIL src/berth.test.js", "  ● berth keeps order", "    Error: expected 3 boats but got 2", "      at Object.<anonymous> (src/berth.test.js:31:11)", "Tests: 1 failed, 20 passed, 21 total", "npm notice new version available", "Downloading report 100%"]
    add("noisy-fail", "generic-test", "make test", 1, _join(noisy), ["berth.test.js:31", "expected 3 boats"], 20, 80)
    add("diff-stat", "git-diff", "git diff", 0, _diff(3, 4), ["files=3"], 15, 70)
    add("giant-diff", "git-diff", "git diff", 0, _diff(8, 9), ["files=8"], 50, 75)
    add("repeated-logs", "generic-summary", "./serve", 0, _join([f"{_clock(i)} INFO worker connected to broker at amber-{i % 2}" for i in range(18)], f"{_clock(30)} ERROR broker went away", f"{_clock(31)} WARN retry in 5s"), ["broker went away"], 30, 70)
    status = ["On branch harbour", "Your branch is up to date with 'origin/harbour'.", "", "Changes to be committed:", '  (use "git restore --staged <file>..." to unstage)', *(f"\tmodified:   pkg/{_n(i)}.go" for i in range(4)), "", "Changes not staged for commit:", '  (use "git add <file>..." to update what will be committed)', *(f"\tmodified:   cmd/{_n(i)}.go" for i in range(3)), "", "Untracked files:", '  (use "git add <file>..." to include in what will be committed)', "\tnotes.txt", "\tdraft.txt"]
    add("git-status-noisy", "git-status", "git status", 0, _join(status), ["harbour", "staged=4"], 30, 80)
    log = []
    for i in range(2):
        log += [f"commit {_hex(i, 40)}", "Author: Ada Harbour <ada@example.org>", "Date:   Tue Sep 2 10:00:00 2025 +0000", "", f"    Keep {_n(i)} berths in order", ""]
    add("git-log-history", "git-log", "git log", 0, _join(log), ["Keep amber berths", "2 commits"], 20, 70)
    go = ["# example.org/harbour/berth", *(f"berth/{_n(i)}.go:{i + 7}:{i + 2}: undefined: Make{_n(i).title()}" for i in range(3)), "berth/jade.go:14:2: declared and not used: err", "note: module requires Go 1.24", "go: downloading example.org/pier v1.2.0 (cached in the module folder of this machine)"]
    add("compiler-diagnostics", "go-build", "go build ./...", 1, _join(go), ["berth/amber.go:7", "berth/jade.go:14"], 10, 80)
    mixed = [*(f"ok  	example.org/harbour/{_n(i)}	0.0{i}s" for i in range(9)), "--- FAIL: TestBerth (0.00s)", "    berth_test.go:21: expected 3 boats, got 2", "FAIL", "FAIL	example.org/harbour/berth	0.004s", "warning: cache is stale", "panic: runtime error: index out of range [3] with length 3", "goroutine 7 [running]:", "example.org/harbour/berth.Order(...)", "	/work/berth/order.go:55 +0x1d"]
    add("mixed-stdout-stderr-fail", "generic-test", "make check", 1, _join(mixed), ["berth_test.go:21", "panic"], 20, 85)
    fetch = [f"remote: Counting objects: {i}% ({i * 4}/400)" for i in range(0, 100, 2)] + [f"Receiving objects: {i}% ({i * 4}/400), {i * 11}.00 KiB | 1.20 MiB/s" for i in range(0, 101, 2)]
    add("git-transfer", "git-fetch", "git fetch", 0, _join(fetch, "From example.org:ada/harbour", [f" * [new branch]      topic/{_n(i)} -> origin/topic/{_n(i)}" for i in range(18)], f"   {_hex(1, 9)}..{_hex(2, 9)}  main       -> origin/main", "remote: Total 400 (delta 120), reused 310 (delta 90)"), ["19 refs", "origin/main"], 80, 80)
    add("go-mod", "go-mod", "go mod tidy", 0, _join([f"go: downloading example.org/{_n(i)}/{_n(i + 7)} v1.{i}.{i % 4}" for i in range(40)], "go: upgraded example.org/pier v1.2.0 => v1.3.0"), ["downloaded 40 modules", "upgraded"], 65, 80)
    apply = [f"deployment.apps/{_n(i)} {('created', 'configured', 'unchanged')[i % 3]}" for i in range(24)] + [f"service/{_n(i)} unchanged" for i in range(15)]
    add("kubectl-apply", "kubectl-apply", "kubectl apply -f .", 0, _join(apply, "Warning: policy/v1beta1 PodDisruptionBudget is deprecated in v1.21+"), ["created", "deprecated"], 60, 80)
    pull = [f"{_hex(i % 12)}: {s}" for s in ("Pulling fs layer", "Waiting", "Downloading", "Verifying Checksum", "Download complete", "Extracting", "Pull complete") for i in range(14)]
    add("docker-transfer", "docker-transfer", "docker pull harbour", 0, _join("Using default tag: latest", "latest: Pulling from ada/harbour", pull, f"Digest: sha256:{_hex(3, 64)}", "Status: Downloaded newer image for ada/harbour:latest", "docker.io/ada/harbour:latest"), ["Digest: sha256", "pulled"], 85, 80)
    add("terraform-plan", "build-system", "terraform plan", 0, _plan(), ["Plan: 8 to add", "aws_instance.amber"], 75, 75)
    watch = []
    for k in range(9):
        watch += [f"{_n(i)}\t{'pending' if k < 8 else ('fail' if i == 2 else 'pass')}\t{k}m{i}s\thttps://example.org/runs/{1000 + i}/job/{_hex(i, 8)}" for i in range(7)]
    add("gh-pr-checks", "gh-pr-checks", "gh pr checks --watch", 8, _join(watch), ["1 fail", "cedar"], 85, 80)
    rep = [f"{_clock(i * 2)} INFO scheduler picked task {_n(i % 3)} for the night shift of the harbour" for i in range(216)]
    add("repeated-timestamped-logs", "generic-summary", "./night", 0, _join(rep, f"{_clock(900)} ERROR lamp 7 is out", f"{_clock(901)} ERROR lamp 7 is out"), ["lamp 7 is out"], 85, 80)
    add("log-read", "cat-read", "cat service.log", 0, _join(_service(221)), ["refused connection", "journal is corrupt"], 85, 90)
    text = ["> harbour@1.0.0 test", "> vitest run", "", *(f" ✓ src/{_n(i)}.test.ts ({i + 1} tests) {i * 3}ms" for i in range(16)), " ❯ src/berth.test.ts (3 tests | 1 failed) 21ms", "   × berth > keeps order 9ms", "     → expected 3 to be 4", "", "⎯⎯ Failed Tests 1 ⎯⎯", "", " FAIL  src/berth.test.ts > berth > keeps order", "AssertionError: expected 3 to be 4 // Object.is equality", "", "- Expected", "+ Received", "", "- 4", "+ 3", "", " ❯ src/berth.test.ts:31:19", "", " Test Files  1 failed | 16 passed (17)", "      Tests  1 failed | 150 passed (151)", " ELIFECYCLE  Test failed. See above for more details."]
    add("js-package-test", "js-package-test", "pnpm test", 1, _join(text), ["berth > keeps order", "src/berth.test.ts:31", "1 failed"], 47, 90)
    pnpm = [" WARN  deprecated inflight@1.0.6: this module is not supported, and leaks memory over time", "Progress: resolved 1, reused 0, downloaded 0, added 0", "Progress: resolved 20, reused 12, downloaded 4, added 0", "Progress: resolved 40, reused 22, downloaded 9, added 0", " ERR_PNPM_FETCH_404  GET https://registry.example.org/pier-left-pad: Not Found - 404", "This error happened while installing a direct dependency of /work/harbour", "pier-left-pad is not in the registry, or you have no permission to fetch it."]
    add("js-workspace", "js-workspace", "pnpm add pier-left-pad", 1, _join(pnpm), ["ERR_PNPM_FETCH_404"], 24, 90)
    rs = [*(f"   Compiling {_n(i)} v0.{i}.1" for i in range(14)), "warning: unused variable: `tide`", "  --> src/tide.rs:9:9", "   |", "9  |     let tide = 4;", "   |         ^^^^ help: prefix it with an underscore: `_tide`", "   |", "   = note: `#[warn(unused_variables)]` on by default", "", "error[E0308]: mismatched types", "  --> src/berth.rs:42:18", "   |", "42 |     let n: u32 = name;", "   |            ---   ^^^^ expected `u32`, found `&str`", "   |            |", "   |            expected due to this", "", "For more information about this error, try `rustc --explain E0308`.", "warning: `harbour` (bin) generated 1 warning", "error: could not compile `harbour` (bin \"harbour\") due to 1 previous error; 1 warning emitted"]
    add("cargo-build", "cargo-build", "cargo build", 101, _join(rs), ["error[E0308]", "src/berth.rs:42"], 50, 90)
    net = ["Microsoft (R) Build Engine", "  Determining projects to restore...", "  All projects are up-to-date for restore."]
    net += [f"/work/Harbour/{_n(i).title()}.cs({i + 3},9): warning CS0168: The variable 'tide' is declared but never used [/work/Harbour/Harbour.csproj]" for i in range(3)] * 2 + ["/work/Harbour/Berth.cs(42,18): error CS0029: Cannot implicitly convert type 'string' to 'int' [/work/Harbour/Harbour.csproj]"] * 2
    add("dotnet-build", "dotnet-build", "dotnet build", 1, _join(net, "", "Build FAILED.", "", "    3 Warning(s)", "    1 Error(s)", "Time Elapsed 00:00:03.11"), ["error CS0029", "Berth.cs(42,18)"], 49, 90)
    rows = [{"id": 1000 + i, "name": _n(i), "status": "degraded" if i == 37 else "ready", "created_at": _clock(i), "region": "north", "image": f"harbour/{_n(i % 4)}:1.{i % 3}"} for i in range(70)]
    add("json-query", "json-query", "jq .", 0, json.dumps(rows), ["degraded", "len=70"], 80, 90)
    env = ["PATH=" + ":".join(f"/opt/{_n(i)}/bin" for i in range(9)), "HOME=/home/ada", "SHELL=/bin/bash", "LANG=C.UTF-8", f"HARBOUR_TOKEN={_hex(1, 40)}", f"PIER_SECRET={_hex(2, 32)}"]
    env += [f"{p}_{_n(i).upper()}=/opt/{p.lower()}/{_n(i)}/share/data/{_n(i + 2)}" for p in ("NIX", "XDG", "BUILD") for i in range(16)] + [f"{_n(i).upper()}={_n(i + 1)}/{_n(i + 2)}" for i in range(6)]
    add("env-print", "env-print", "env", 0, _join(env), ["<redacted len=40>", "NIX_*"], 62, 75)
    img = ["REPOSITORY                TAG       IMAGE ID       CREATED         SIZE"] + [f"{'<none>' if i % 4 == 3 else 'example.org/harbour/' + _n(i):<38} {'<none>' if i % 4 == 3 else f'1.{i}.0':<11} {_hex(i)}   {i + 2} days ago      {150 + i * 37}MB" for i in range(20)]
    add("docker-images", "docker-images", "docker images", 0, _join(img), ["20 images", "5 dangling"], 60, 75)
    pipe = [f"({'failed' if i == 11 else 'running' if i == 0 else 'success'}) • #{9000 - i}	main	(about {i + 1} hours ago)" for i in range(41)]
    add("glab-pipeline", "glab-pipeline", "glab pipeline list", 0, _join("Showing 41 pipelines on ada/harbour (Page 1)", pipe), ["1 failed", "#8989"], 70, 75)
    gr = [*(f"> Task :{_n(i)}:compileJava UP-TO-DATE" for i in range(22)), "> Task :berth:compileKotlin FAILED", "", "e: file:///work/berth/src/main/kotlin/Berth.kt:42:18 Type mismatch: inferred type is String but Int was expected", "w: file:///work/berth/src/main/kotlin/Tide.kt:9:9 Variable 'tide' is never used", "", "FAILURE: Build failed with an exception.", "", "* What went wrong:", "Execution failed for task ':berth:compileKotlin'.", "> A failure occurred while executing compile work", "   > Compilation error. See log for more details", "", "* Try:", "> Run with --stacktrace option to get the stack trace.", "> Run with --info or --debug option to get more log output.", "> Get more help at https://help.gradle.org.", "", "BUILD FAILED in 4s", "23 actionable tasks: 1 executed, 22 up-to-date"]
    add("gradle-build", "gradle-build", "gradle build", 1, _join(gr), ["Berth.kt:42", "BUILD FAILED"], 45, 80)
    pu = ["Previewing update (harbour/dev)", "", "View in Browser (Ctrl+O): https://app.example.org/ada/harbour/dev/previews/1", "", "     Type                       Name                Plan       Info"]
    pu += [f" {'+' if i % 9 == 4 else '~' if i == 7 else ' '}   ├─ aws:s3:BucketObject       {_n(i)}-{_hex(i, 6)}-object-of-the-harbour     {'create' if i % 9 == 4 else 'update' if i == 7 else ''}" for i in range(40)]
    add("pulumi-diff", "pulumi-diff", "pulumi preview", 0, _join(pu, "", "Resources:", "    + 4 to create", "    ~ 1 to update", "    35 unchanged", "", "Duration: 7s"), ["Resources:", "4 to create"], 55, 75)
    fn = [{"FunctionName": f"harbour-{_n(i)}", "FunctionArn": f"arn:aws:lambda:eu-north-1:000000000000:function:harbour-{_n(i)}", "Runtime": "python3.12" if i % 3 else "nodejs20.x", "Role": f"arn:aws:iam::000000000000:role/harbour-{_n(i)}", "Handler": "app.handler", "CodeSize": 20_000 + i * 1313, "Timeout": 30, "MemorySize": 128 * (1 + i % 4), "LastModified": _clock(i), "CodeSha256": _hex(i, 44), "Version": "$LATEST", "TracingConfig": {"Mode": "PassThrough"}, "PackageType": "Zip", "Architectures": ["arm64"]} for i in range(16)]
    add("aws-lambda-functions", "aws-lambda-functions", "aws lambda list-functions", 0, json.dumps({"Functions": fn}, indent=4), ["16 functions", "harbour-amber"], 85, 75)
    return f


SCHEMA = "name string, profile_name string, command string, exit_code int, text string, expected array<string>, min_savings double, min_quality int"
