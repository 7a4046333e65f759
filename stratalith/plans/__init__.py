"""Driver-side query planning: text checks, parameters, tenant scope, pipeline."""
