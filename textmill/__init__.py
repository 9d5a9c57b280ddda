"""textmill: text corpus jobs on Spark.

Modules: ``functions.text`` (Column functions), ``operators`` (chunking,
lines, ranges, corpus, versions, hygiene, deps, requests, answers, prompts,
infer, rewrite), ``sources.files`` (file trees, UTF-8 decode),
``streaming.requests`` (request stream), ``plans`` (the registered queries
and their SQL), ``session`` (session conf, checkpoint folder, spread,
bounded broadcast).
"""

__version__ = "0.1.0"
