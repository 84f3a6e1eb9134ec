"""Ready-made analyses over a data folder, and the SQL that expresses them."""
