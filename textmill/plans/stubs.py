"""Deterministic stand-ins for a model, for the registered queries and tests."""

from __future__ import annotations

from collections.abc import Callable

from ..operators.infer import Predict
from ..operators.prompts import CODE_CLOSE, CODE_OPEN


def replace_stub(old: str = "the", new: str = "THE", fence: bool = True) -> Callable[[], Predict]:
    """A deterministic stand-in for a model: takes the code between the
    prompt's code markers, replaces ``old`` by ``new`` and answers it inside
    a fenced block. Prompts without markers get no answer."""

    def factory() -> Predict:
        def predict(systems, users):
            out = []
            for u in users:
                i = u.find(CODE_OPEN)
                j = u.rfind(CODE_CLOSE)
                if i < 0 or j < i:
                    out.append(None)
                    continue
                code = u[i + len(CODE_OPEN):j].replace(old, new)
                out.append(f"```\n{code}\n```" if fence else code)
            return out

        return predict

    factory.deterministic = True
    return factory


def convert_stub(new_suffix: str = ".go", old: str = "the", new: str = "THE") -> Callable[[], Predict]:
    """A deterministic stand-in for a conversion model: reads the files block
    of the prompt and answers ``{"files": [{"path", "content"}], "notes"}``
    with each path's suffix swapped and ``old`` replaced by ``new``."""
    import json as _json
    import re as _re
    from pathlib import PurePosixPath

    block = _re.compile(r"### file: (.*?)\n### language: [^\n]*\n(.*?)\n### end of file", _re.S)

    def factory() -> Predict:
        def predict(systems, users):
            out = []
            for u in users:
                files = []
                for path, content in block.findall(u):
                    target = str(PurePosixPath(path).with_suffix(new_suffix)) if PurePosixPath(path).name else path
                    files.append({"path": target, "content": content.replace(old, new)})
                out.append(_json.dumps({"files": files, "notes": f"{len(files)} files converted"}))
            return out

        return predict

    factory.deterministic = True
    return factory

