"""Tasks, views, aggregation, materialisation, analysis and workflows."""
