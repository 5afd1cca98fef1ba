"""Tables in and out: typed readers, sinks, model artefacts."""
