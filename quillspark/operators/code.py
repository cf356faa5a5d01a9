"""Code search: symbols and calls of Python and C++ files, lexical scores, ranking."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import URL_NAMESPACE, every, name_uuid

#: Words of a question and what they stand for in code.
SYNONYMS = {
    "安装": ["install", "setup", "build", "package", "pip", "cmake"], "构建": ["build", "cmake", "compile", "make"], "编译": ["build", "compile", "cmake", "make"], "训练": ["train", "fit", "learner", "booster"],
    "预测": ["predict", "inplace_predict", "prediction"], "数据": ["data", "dmatrix", "matrix", "adapter"], "处理": ["process", "handle", "adapter", "batch"], "加载": ["load", "read", "deserialize"],
    "保存": ["save", "write", "serialize"], "参数": ["param", "config", "configure"], "模型": ["model", "booster", "learner"], "调用": ["call", "invoke"],
    "分布式": ["distributed", "rabit", "collective", "allreduce"], "显卡": ["gpu", "cuda", "device"],
}


def query_tokens(text: Column) -> Column:
    """Names and numbers, their letter and digit parts, and synonyms; two characters at least, each once, in order."""
    names = every(F.lower(text), r"[A-Za-z_][A-Za-z0-9_]*|\d+")
    parts = F.flatten(F.transform(names, lambda n: F.concat(F.array(n), every(n, r"[a-z]+|\d+"))))
    more = F.concat(*[F.when(F.contains(text, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()])
    return F.array_distinct(F.filter(F.concat(parts, more), lambda t: F.length(t) >= 2))


def path_penalty(path: Column) -> Column:
    p = F.concat(F.lit("/"), F.lower(path))
    return F.when(p.rlike("/tests?/|/test_"), 0.12).otherwise(0.0)


def _hits(tokens: Column, place: Column, weight: float) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(F.coalesce(place, F.lit(""))), t))) * weight


def _home(path: Column, a: float, b: float) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("/src/|/include/"), a).otherwise(0.0) + F.when(F.contains(p, F.lit("/python-package/xgboost/")), b).otherwise(0.0)


def lexical_boost(tokens: Column) -> Column:
    """Over the columns qualified_name, signature, path, docstring."""
    boost = _hits(tokens, F.col("qualified_name"), 0.09) + _hits(tokens, F.col("signature"), 0.04) + _hits(tokens, F.col("path"), 0.03) + _hits(tokens, F.col("docstring"), 0.02)
    p = F.lower(F.col("path"))
    home = F.when(p.rlike("/src/|/include/|/python-package/xgboost/"), 0.025).otherwise(0.0)
    return F.round(F.when(F.size(tokens) == 0, 0.0).otherwise(boost + home) - path_penalty(F.col("path")), 6)


def function_score(tokens: Column) -> Column:
    s = _hits(tokens, F.col("qualified_name"), 0.16) + _hits(tokens, F.col("signature"), 0.08) + _hits(tokens, F.col("path"), 0.06) + _hits(tokens, F.col("docstring"), 0.04)
    return F.round(F.greatest(F.lit(0.0), F.when(s > 0, s + _home(F.col("path"), 0.04, 0.03)).otherwise(0.0) - path_penalty(F.col("path"))), 6)


def file_score(tokens: Column, content: Column) -> Column:
    low = F.lower(content)
    times = lambda t: (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)
    inside = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.least(F.lit(0.12), times(t) * 0.025))
    s = _hits(tokens, F.col("path"), 0.09) + inside
    return F.round(F.greatest(F.lit(0.0), F.when(s > 0, s + _home(F.col("path"), 0.04, 0.03)).otherwise(0.0) - path_penalty(F.col("path"))), 6)


def text_hits(rows: DataFrame, score: Column) -> DataFrame:
    """Rows that score at all, as 0.75 and their score."""
    return rows.withColumn("_s", score).filter(F.col("_s") > 0).withColumn("score", F.round(F.lit(0.75) + F.col("_s"), 6)).drop("_s")


def merged_hits(lists: list[DataFrame], by: str, key: str) -> DataFrame:
    """(by, key, score, rank): of each question the best score of each key over several lists (by, key, score, ord); ties by where a key came first."""
    rows = None
    for i, df in enumerate(lists):
        one = df.select(by, key, "score", F.struct(F.lit(i).alias("l"), F.col("ord").alias("o")).alias("_first"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy(by, key).agg(F.max("score").alias("score"), F.min("_first").alias("_first"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "_first"))).drop("_first")


def ranked(hits: DataFrame, tokens: Column, by: str, k: int) -> DataFrame:
    total = F.round(F.col("vector_score") + lexical_boost(tokens), 6)
    w = Window.partitionBy(by).orderBy(F.desc("final_score"), F.desc("vector_score"), path_penalty(F.col("path")) > 0, "id")
    return hits.withColumn("final_score", total).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- symbols and calls


def python_symbols(source: str) -> list[dict]:
    """Classes and functions with dotted scopes, and the calls in functions (nested ones count for outer and inner)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.splitlines(), []

    def called(node: ast.AST) -> list[tuple[str, int]]:
        return sorted({(ast.unparse(c.func), c.lineno) for c in ast.walk(node) if isinstance(c, ast.Call)})

    def visit(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                head = "\n".join(lines[child.lineno - 1 : max(child.lineno, child.body[0].lineno - 1)])
                name = ".".join([*scope, child.name])
                out.append({"name": child.name, "qualified_name": name, "kind": kind, "signature": head.strip(), "docstring": (ast.get_docstring(child) or "").strip(), "start_line": child.lineno, "end_line": child.end_lineno, "calls": called(child) if kind == "function" else []})
                visit(child, [*scope, child.name])
            else:
                visit(child, scope)

    visit(tree, [])
    return out


_blanked = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_class = re.compile(r"\b(?:class|struct)\s+(?:\w+\s+)*?(\w+)\s*(?:final\s*)?(?::[^;{}]*)?$")
_function = re.compile(r"([~\w:]+(?:<[^<>;{}]*>)?(?:::[~\w]+)*|operator\s*\S+)\s*\([^;{}]*\)[^;{}()]*(?::[^;{}]*)?$")
#: Words before a parenthesis that are no functions.
NO_FUNCTIONS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "defined", "decltype", "alignof", "TEST", "TEST_F", "TEST_P"}


def cpp_symbols(source: str) -> list[dict]:
    """Classes and functions by a scan of braces; scopes are those of classes, not of namespaces."""
    text = _blanked.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), source)
    out, stack, start = [], [], 0
    for m in re.finditer(r"[{};]", text):
        at, c = m.start(), m.group(0)
        if c == "{":
            head = text[start:at]
            label = re.sub(r"^\s*(?:#[^\n]*\n|public:|private:|protected:|\s)*", "", head)
            scope = [s["name"] for s in stack if s["kind"] == "class"]
            entry = {"name": "", "kind": "other"}
            found, fn = _class.search(label.strip()), _function.search(label.strip())
            if found:
                entry = {"name": found[1], "qualified_name": "::".join([*scope, found[1]]), "kind": "class"}
            elif fn and fn[1] not in NO_FUNCTIONS and not any(s["kind"] == "function" for s in stack):
                entry = {"name": fn[1].split("::")[-1], "qualified_name": fn[1] if "::" in fn[1] else "::".join([*scope, fn[1]]), "kind": "function"}
            if entry["kind"] != "other":
                begin = at - len(label)
                entry |= {"signature": source[begin:at].strip(), "docstring": "", "start_line": text.count("\n", 0, begin) + 1, "begin": at, "calls": []}
            stack.append(entry)
        elif c == "}" and stack:
            entry = stack.pop()
            if entry["kind"] != "other":
                entry["end_line"] = text.count("\n", 0, at) + 1
                begin = entry.pop("begin")
                if entry["kind"] == "function":
                    entry["calls"] = sorted({(x[1], text.count("\n", 0, begin + x.start(1)) + 1) for x in re.finditer(r"([A-Za-z_][\w:.]*(?:->\w+)*)\s*\(", text[begin:at]) if x[1] not in NO_FUNCTIONS})
                out.append(entry)
        start = at + 1
    return sorted(out, key=lambda e: e["start_line"])


SYMBOLS = "repository_id string, path string, name string, qualified_name string, kind string, signature string, docstring string, start_line int, end_line int, calls array<struct<callee: string, line: int>>"


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of each file (repository_id, path, language, full_content), with calls and a stable id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for repo, path, language, text in zip(f["repository_id"], f["path"], f["language"], f["full_content"], strict=True):
                for s in (python_symbols if language == "python" else cpp_symbols)(text or ""):
                    rows.append({"repository_id": repo, "path": path} | s | {"calls": [{"callee": c, "line": n} for c, n in s["calls"]]})
            yield pd.DataFrame(rows, columns=["repository_id", "path", "name", "qualified_name", "kind", "signature", "docstring", "start_line", "end_line", "calls"])

    rows = files.select("repository_id", "path", "language", "full_content").mapInPandas(run, SYMBOLS)
    label = F.concat_ws(":", F.lit("code-function"), "repository_id", "path", "qualified_name", "kind", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return rows.withColumn("id", name_uuid(URL_NAMESPACE, label))
