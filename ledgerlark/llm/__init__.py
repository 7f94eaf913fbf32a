"""Training-data operators: ten document, page, vector and conversation transforms and their queries."""
