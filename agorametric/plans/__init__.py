"""The phases: audit, cleaning, validation, marts, descriptive and diagnostic reports, and the pipeline over them."""
