"""Named extension points: a name belongs to one implementation."""

from __future__ import annotations


class Registry(dict):
    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, *names: str):
        def put(fn):
            for name in names:
                if self.get(name, fn) is not fn:
                    raise ValueError(f"{self.kind} {name!r} is registered already")
                self[name] = fn
            return fn

        return put

    def lookup(self, name: str):
        if name not in self:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self))}")
        return self[name]
