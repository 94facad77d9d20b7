"""Ready-made queries over the given tables, each with its SQL counterpart."""


def all_suites():
    from fleetlens.plans import alerts, fleet, history, ingest, live, streams

    return [history.SUITE, ingest.SUITE, live.SUITE, alerts.SUITE, fleet.SUITE, streams.SUITE]
