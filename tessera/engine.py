"""A facade: one object over a graph and its logs, with the tools by name and a router for plain questions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import code, text
from .operators import context, graph, guard, ledger, search, traverse
from .sources.store import Store


class Engine:
    """Tools over nodes, edges and (where given) a ledger (session, call, tool, ts, tokens) and a store. Every tool returns a frame.

    disabled: modules whose tools are left out. answer: makes a frame of a question and the best nodes, in place of a local answer.
    vectors, embed: vec_id (node id) and embedding of nodes, and what makes a vector of a question. log_call: told of every tool call.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, log: DataFrame | None = None, answer: Callable[[str, DataFrame], DataFrame] | None = None, store: Store | None = None, disabled: tuple[str, ...] = (), vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, log_call: Callable[[str, dict], None] | None = None):
        self.nodes, self.edges, self.log, self.answer, self.store = nodes, edges, log, answer, store
        self.vectors, self.embed, self.log_call = vectors, embed, log_call
        self.spark = nodes.sparkSession
        off = {t for m in disabled for t in guard.MODULE_TOOLS[m]}
        every: dict[str, Callable[..., DataFrame]] = {
            "query_graph": self.query_graph,
            "get_dependencies": lambda node: graph.neighbours(self.nodes, self.edges, node, incoming=False),
            "find_callers": lambda node: graph.neighbours(self.nodes, self.edges, node, incoming=True),
            "get_summary": lambda label: self.nodes.where(F.lower("label") == label.lower()),
            "list_communities": lambda: graph.community_rollup(self.nodes),
            "cost_report": lambda price=3.0: self._log().agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * price / 1e6, 6).alias("usd")),
            "analyze_impact": lambda node, depth=3: traverse.impact_listed(traverse.impact(self.nodes, self.edges, node, depth)),
            "get_graph_diff": self.get_graph_diff,
            "list_packages": lambda: self.nodes.where("type = 'external'").select(code.package_of(F.col("label")).alias("package")).distinct(),
            "remember": self.remember,
            "recall": lambda category, n=8: self._store().memory(n).where(F.col("category") == category).orderBy("ts", "text").select("category", "text"),
            "scan_suggestion": lambda diff: self._one(diff).select(F.inline(code.added_imports(F.col("t")))),
            "validate_import": self.validate_import,
            "get_active_context": lambda: ledger.usage(self._log()),
            "measure_token_usage": lambda: ledger.share(self._log()),
            "trace_last_tool_calls": lambda n=20: ledger.last_calls(self._log(), n),
            "create_checkpoint": self.create_checkpoint,
            "get_task_progress": lambda task: self._store().checkpoints().where(F.col("task") == task).groupBy("task").agg(F.count("*").alias("checkpoints"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "rolled_back").alias("rolled_back"), F.sum("tokens").alias("tokens")),
            "rollback_to_checkpoint": lambda checkpoint: self._frame([(self._store().rollback(checkpoint),)], "rolled_back long"),
            "list_checkpoints": lambda task=None: self._store().checkpoints().where(F.lit(True) if task is None else F.col("task") == task).orderBy("ts", "checkpoint") if self.store else ledger.checkpoint_chain(self._log()),
            "check_budget": lambda cap: ledger.budget(self._log(), cap),
            "get_applicable_rules": lambda path, content="": guard.applicable_rules(self._layer(path, content), self._store().read("learned")),
            "learn_from_accept": self.learn_from_accept,
            "export_symbols": lambda files: files.select("path", F.inline(code.symbols(F.col("content"), code.language(F.col("path"))))),
        }
        self.tools = {k: v for k, v in every.items() if k not in off}

    def _log(self) -> DataFrame:
        if self.log is None:
            raise ValueError("this engine has no ledger")
        return self.log

    def _store(self) -> Store:
        if self.store is None:
            raise ValueError("this engine has no store")
        return self.store

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _one(self, value: str) -> DataFrame:
        return self._frame([(value,)], "t string")

    def tool(self, name: str, **args) -> DataFrame:
        if self.log_call:
            self.log_call(name, args)
        return self.tools[name](**args)

    def remember(self, category: str, entry: str) -> DataFrame:
        self._store().append("memory", [(category, entry, None)])
        return self.tools["recall"](category)

    def create_checkpoint(self, task: str, description: str, files: tuple[str, ...] = (), tokens: int = 0) -> DataFrame:
        key = self._store().create_checkpoint(task, description, list(files), tokens)
        return self._store().checkpoints().where(F.col("checkpoint") == key)

    def learn_from_accept(self, diff: str, description: str) -> DataFrame:
        layer = self._one(diff).select(code.layer_of_diff(F.col("t"))).first()[0]
        self._store().append("learned", [(layer, description, diff[:200], None)])
        return self._store().read("learned").groupBy("layer").agg(F.count("*").alias("learned"))

    def _layer(self, path: str, content: str) -> DataFrame:
        df = self._frame([(path, content)], "path string, content string")
        return df.select("path", code.layer(F.col("path"), code.imports(F.col("content"), F.lit("python"))).alias("layer"))

    def get_graph_diff(self, old_nodes: DataFrame | None = None, old_edges: DataFrame | None = None) -> DataFrame:
        """Against given frames, else the difference that the last build stored."""
        if old_nodes is None:
            return self._store().load_diff()
        return graph.diff_nodes(old_nodes, self.nodes).unionByName(graph.diff_edges(old_edges, self.edges).select(F.concat_ws(" ", "src", "relation", "dst").alias("id"), "change"))

    def validate_import(self, module: str, symbol: str | None = None) -> DataFrame:
        """module, symbol, valid, severity and close names; a module's symbols are what the graph says it defines."""
        ids = self.nodes.select(F.col("id").alias("src"), F.col("label").alias("module"))
        symbols = self.edges.where("relation = 'defines'").join(ids, "src").join(self.nodes.select(F.col("id").alias("dst"), F.col("label").alias("symbol")), "dst").select("module", "symbol")
        alone = self.nodes.where("type in ('module', 'external')").select(F.col("label").alias("module"), F.lit(None).cast("string").alias("symbol"))
        known, wanted = symbols.unionByName(alone), self._frame([(module, symbol)], "module string, symbol string")
        names = guard.suggestions(wanted, symbols).groupBy("module", "symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("close"))
        return guard.validity(wanted, known).join(names, ["module", "symbol"], "left")

    # ---- questions

    def _labelled(self, label: str) -> DataFrame:
        """Nodes with that label in any case, else those whose label has it in it."""
        low = F.lower("label")
        hit = self.nodes.withColumn("how", F.when(low == label.lower(), 0).when(F.contains(low, F.lit(label.lower())), 1)).where("how is not null")
        return hit.join(F.broadcast(hit.agg(F.min("how").alias("how"))), "how").drop("how")

    def _routes(self) -> list[tuple[str, Callable[[re.Match], DataFrame | None]]]:
        """Patterns in order; the first that matches and whose handler gives rows answers."""

        def callers(m: re.Match) -> DataFrame:
            ends = self.edges.join(self._labelled(m[1]).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
            return ends.join(self.nodes, "id").select("id", "label", "type", "file").orderBy("id").limit(20)

        def dependencies(m: re.Match) -> DataFrame:
            symbol = (m[1] or m[2] or "").strip("./")
            found = self._labelled(symbol)
            if found.isEmpty():
                found = self.nodes.where(F.contains(F.lower("file"), F.lit(symbol.lower())))
            first = found.orderBy("id").limit(1).select(F.col("id").alias("src"))
            out = self.edges.join(F.broadcast(first), "src").select(F.col("dst").alias("id"), "relation")
            return out.join(self.nodes, "id").select("id", "label", "relation", "summary").orderBy("id").limit(25)

        def path(m: re.Match) -> DataFrame | None:
            ends = [self._labelled(x).orderBy("id").first() for x in (m[1] or m[3], m[2] or m[4])]
            return None if None in ends else traverse.shortest_path(self.edges, ends[0].id, ends[1].id)

        name = r"[`\"']?(\w+)[`\"']?"
        return [
            (rf"(?:who|what)\s+calls?\s+{name}", callers),
            (r"(?:what does\s+)?[`\"']?(\w[\w./]+)[`\"']?\s+(?:depends? on|imports?|uses?|needs?)|depend(?:encies|s)? of\s+[`\"']?(\w[\w./]+)[`\"']?", dependencies),
            (r"(?:list|show|what)\s+(?:are\s+(?:the\s+))?(?:all\s+)?(?:modules?|communit(?:y|ies)|clusters?|packages?|groups?)", lambda m: graph.community_rollup(self.nodes)),
            (r"god nodes?|most connected|highest degree|top (\d+) connected|most coupled", lambda m: graph.top_by_degree(self.nodes, self.edges, int(m[1] or 10), isolated=True)),
            (rf"(?:summary|describe|what is|explain)\s+{name}|{name}\s+summary", lambda m: self._labelled(m[1] or m[2]).orderBy("id").limit(1).select("id", "label", "type", "summary", "file")),
            (r"how many\s+(?:files?|nodes?|functions?|classes?|modules?|edges?|connections?|communities)|stats?|statistics|count|total", lambda m: graph.count_by(self.nodes, "type", "unknown").orderBy(F.desc("n"), "type")),
            (r"isolated nodes?|dead code|unused|orphan(?:ed)? nodes?|no connections?|disconnected", lambda m: graph.isolated(self.nodes, self.edges, ("external", "community")).orderBy("id").limit(20)),
            (rf"path (?:from|between)\s+{name}\s+(?:to|and)\s+{name}|how does\s+{name}\s+connect to\s+{name}", path),
        ]

    def route(self, question: str) -> DataFrame | None:
        for pattern, handler in self._routes():
            if m := re.search(pattern, question, re.I):
                found = handler(m)
                if found is not None and not found.isEmpty():
                    return found
        return None

    def words(self, question: str) -> list[str]:
        return list(dict.fromkeys(w.lower() for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", question) if len(w) >= 3 and w.lower() not in text.STOP_WORDS))

    def seeds(self, question: str, k: int = 15) -> tuple[DataFrame, DataFrame | None]:
        """Seed ids by vectors where there are any, else by keywords; and the vectors' scores."""
        if self.vectors is not None and self.embed is not None:
            q = self._frame([(self.embed(question),)], "embedding array<double>")
            scored = search.dense_top_k(self.vectors, q, k).select(F.col("vec_id").alias("id"), "score")
            return scored.select("id"), scored
        return context.seeds(self.nodes, self.words(question)).select("id"), None

    def search(self, question: str, k: int = 10) -> DataFrame:
        """id, score: the best nodes by ranked words, within the subgraph around the question's seeds if it has any."""
        asked = [w for w in re.findall(r"[a-z0-9_]+", question.lower()) if len(w) > 1 and w not in text.RANKING_STOP_WORDS]
        seeds, scores = self.seeds(question)
        if seeds.isEmpty():
            return search.keyword_search(self.nodes, asked, k)
        near = context.subgraph(self.nodes, self.edges, seeds, 1, 20, embeddings=scores)
        return search.keyword_search(near.select(*self.nodes.columns), asked, k)

    def query_graph(self, question: str, k: int = 10) -> DataFrame:
        """A deterministic answer if a route has one, else the best nodes, or what `answer` makes of those."""
        found = self.route(question)
        if found is not None:
            return found
        best = self.search(question, k)
        return self.answer(question, best) if self.answer else best

    def ask(self, question: str, k: int = 10, least: float = 0.8) -> str:
        """An answer as text: the stored one of an equal or similar question, a route's rows, or the best nodes with their neighbours."""
        key = self._one(question).select(search.question_key(F.col("t"))).first()[0]
        if self.store:
            hit = search.stored_answer(self.store.questions(), question, key, least).first()
            if hit:
                self.store.append("questions", [(hit.key, None, None, None, True)])
                return hit.answer
        found = self.route(question)
        if found is not None:
            said = "\n".join("- " + " · ".join(str(v) for v in r if v is not None) for r in found.limit(50).collect())
        else:
            rows = context.local_answer(self.search(question, k), self.nodes, self.edges).orderBy(F.desc("score"), "id").collect()
            said = "\n\n".join([f"Results for: {question!r}", *(r.entry for r in rows), f"Found {len(rows)} matching nodes."]) if rows else f"No nodes found matching: {question!r}"
            said += f"\n\ncontext_tokens_used: {len(said) // 4}"
        if self.store:
            self.store.append("questions", [(key, question, said, None, False)])
        return said

    def context(self, question: str, budget: int = 6000, k: int = 1) -> str:
        """Lines of the subgraph around a question, for a model."""
        seeds, scores = self.seeds(question)
        chosen = context.subgraph(self.nodes, self.edges, seeds, k, budget=budget, embeddings=scores)
        shown = context.lines(chosen, self.edges, budget)
        return context.as_text(shown, f"Codebase subgraph ({chosen.count()} nodes):")
