"""Sources and sinks: index bundles, manifest, catalog."""
