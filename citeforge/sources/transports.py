"""Language models and web look-ups behind one shape: a factory, called once in each task, of a function from a list to a list."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable


def mock(prefix: str = "(mock) ", chars: int = 200) -> Callable:
    """Answers with the head of the prompt; no model is reached."""
    return lambda: lambda prompts: [prefix + (p or "")[:chars].replace("\n", " ") for p in prompts]


def http_chat(url: str, model: str, max_tokens: int = 1600, temperature: float = 0.0, timeout: float = 300.0, json_mode: bool = False, think_budget: int = 0, seconds_per_token: float = 0.0, headers: dict | None = None, hosted: bool = False) -> Callable:
    """A chat server with the widespread messages interface; a failed call gives null.

    Local servers get their limits as options; hosted ones (`hosted`) as fields of the request, and say their text in `content`.
    json_mode asks for a JSON object. A thinking budget is added to the tokens, and what was thought is cut off. With
    seconds_per_token the time-out grows with prompt and answer, as far as it exceeds `timeout`.
    """

    def make():
        def body_of(p: str) -> dict:
            said = {"model": model, "messages": [{"role": "user", "content": p}]}
            if hosted:
                return said | {"max_tokens": max_tokens + think_budget, "temperature": temperature} | ({"response_format": {"type": "json_object"}} if json_mode else {})
            options = {"num_predict": max_tokens + think_budget, "temperature": temperature}
            return said | {"stream": False, "options": options} | ({"format": "json"} if json_mode else {})

        def text_of(answer: dict) -> str:
            if "message" in answer:
                text = answer["message"]["content"]
            else:
                content = answer["content"] if "content" in answer else answer["choices"][0]["message"]["content"]
                text = content if isinstance(content, str) else "".join(c.get("text", "") for c in content)
            return re.sub(r"(?s)<think>.*?</think>", "", text).strip()

        def call(prompts: list) -> list:
            out = []
            for p in prompts:
                wait = max(timeout, 60 + (max_tokens + think_budget + len(p or "") / 2.5 * 0.5) * seconds_per_token)
                try:
                    request = urllib.request.Request(url, json.dumps(body_of(p or "")).encode(), {"Content-Type": "application/json", **(headers or {})})
                    with urllib.request.urlopen(request, timeout=wait) as r:
                        out.append(text_of(json.load(r)))
                except (OSError, ValueError, KeyError, IndexError):
                    out.append(None)
            return out

        return call

    return make


def http_json(gap: float = 1.0, attempts: int = 4, get: Callable | None = None) -> Callable:
    """GET with a least gap between calls; waits 2, 4, 8 ... seconds after 429, 5xx or a broken connection. Gives (status, body) for each
    address: body is null for anything but a success, and no failure ends the task."""

    def make():
        last = [0.0]

        def one(url: str) -> tuple[int, str | None]:
            status = 0
            for k in range(attempts):
                time.sleep(max(0.0, last[0] + gap - time.time()))
                last[0] = time.time()
                try:
                    if get:
                        return 200, get(url)
                    with urllib.request.urlopen(url, timeout=30) as r:
                        return r.status, r.read().decode()
                except urllib.error.HTTPError as e:
                    status = e.code
                    if e.code != 429 and e.code < 500:
                        return status, None
                except OSError:
                    status = 0
                if k + 1 < attempts:
                    time.sleep(2 ** (k + 1))
            return status, None

        return lambda urls: [one(u) for u in urls]

    return make


def fetch(urls, known, transport: Callable, trim: Callable | None = None):
    """urls (url) to url, status, body: those of the table `known` (url, status, body) first, the others by the transport, one task a
    host. `trim` cuts a body down before it is kept."""
    from pyspark.sql import functions as F

    missing = urls.distinct().join(known, "url", "left_anti").withColumn("host", F.parse_url("url", F.lit("HOST")))

    def run(batches):
        call = transport()
        for b in batches:
            got = call(b["url"].tolist())
            yield b[["url"]].assign(status=[s for s, _ in got], body=[trim(x) if trim and x is not None else x for _, x in got])

    return known.join(urls, "url", "left_semi").unionByName(missing.repartition("host").select("url").mapInPandas(run, "url string, status int, body string"))


def fetch_and_keep(urls, path: str, transport: Callable, trim: Callable | None = None):
    """`fetch` with a cache of Parquet files at `path`: new answers (also that there is none, 404) are appended, failures are not."""
    from pyspark.sql import functions as F

    spark = urls.sparkSession
    schema = "url string, status int, body string"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    fresh = fetch(urls, known, transport, trim).join(known.select("url"), "url", "left_anti").select("url", "status", "body")
    fresh.where(F.col("status").isin(200, 404)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(urls.distinct(), "url", "left_semi")
