"""Command line: python -m flockwise VERB --source DIR --root DIR --as-of TIME."""

from __future__ import annotations

import argparse

from flockwise.operators.communities import PURGES
from flockwise.operators.export import BUNDLES, bundle_model, unbundle_model
from flockwise.plans.pipeline import Engine
from flockwise.session import build_session

VERBS = ("run", "refresh", "export", "validate", "user", "post", "train", "clean", "cleanup", "reindex", "model-export", "model-import")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flockwise")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--source", required=True)
    parser.add_argument("--root", required=True)
    parser.add_argument("--as-of", required=True)
    parser.add_argument("--master", help="Spark master; the cluster's own under spark-submit")
    parser.add_argument("--hours", type=float, default=24.0)
    parser.add_argument("--id", type=int)
    parser.add_argument("--viewer", type=int, help="the user whose feed a post is explained for")
    parser.add_argument("--kind", choices=sorted(PURGES), default="interests", help="what to clean")
    parser.add_argument("--model", help="directory or archive of a model")
    parser.add_argument("--mode", choices=sorted(BUNDLES), default="full", help="what a bundle holds")
    parser.add_argument("--target", help="where a model goes")
    parser.add_argument("--dry-run", action="store_true", help="no feeds")
    given = parser.parse_args(args)
    engine = Engine(build_session(given.master, checkpoints=f"{given.root.rstrip('/')}/_checkpoints"), given.source, given.root)
    if given.verb == "run":
        print(engine.run(given.as_of, not given.dry_run))
    elif given.verb == "refresh":
        rows = engine.refresh(given.as_of, given.hours)
        rows.write.mode("overwrite").parquet(f"{given.root}/refreshed_interests")
    elif given.verb == "export":
        print(engine.export(given.as_of, given.id))
    elif given.verb == "validate":
        print(engine.validate(), *engine.warnings(), sep="\n")
    elif given.verb == "train":
        print(engine.train(given.model))
    elif given.verb == "clean":
        print(engine.clean(given.kind))
    elif given.verb == "cleanup":
        print(engine.cleanup(given.as_of))
    elif given.verb == "reindex":
        print(engine.reindex())
    elif given.verb == "model-export":
        print(bundle_model(engine.spark, given.model, given.target, {"source": given.source}, given.mode))
    elif given.verb == "model-import":
        print(unbundle_model(engine.spark, given.model, given.target))
    else:
        for df in engine.user(given.id) if given.verb == "user" else engine.post(given.id, given.as_of, given.viewer):
            df.show(truncate=60, vertical=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
